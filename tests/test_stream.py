import json
import os
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stockweave.plans import dashboard
from stockweave.schemas import EVENT_SCHEMA, StreamParams
from stockweave.streaming import events as ev
from stockweave.streaming import fold, replay, rules, state
from stockweave.streaming.run import StreamJob
from stockweave.streaming.state import stock_accounts

T0 = datetime(2024, 1, 1)
P = StreamParams()


def event(i, kind="SALES", sku="1", value=1, price=2.0, pais="PY", **kw):
    e = dict(evento_id=f"e{i:06d}", timestamp=T0 + timedelta(minutes=i), fecha_original=T0.date(), tipo_evento=kind, pais=pais,
             codigo_sku=sku, familia="F", modelo="M1", marca="A", tier="LOW", estado="ACTIVE", codigo_bodega="B", value=value,
             precio_unitario=price, costo=1.0, fuente="REAL")
    e.update(kw)
    return e


def frame(spark, events):
    return spark.createDataFrame([tuple(e.values()) for e in events], EVENT_SCHEMA)


def random_events(n, seed, kinds=("SALES", "SALES", "INVENTORY"), keys=("hot", "hot", "hot", "a", "b")):
    rnd = random.Random(seed)
    return [event(i, rnd.choice(kinds), rnd.choice(keys), rnd.randint(1, 20), rnd.choice([0.0, 1.5, 3.0]),
                  estado=rnd.choice(["", "ACTIVE", "NEW"]), modelo=rnd.choice(["", "M1", "M2"])) for i in range(n)]


def stepwise(events, start=None):
    """Plain step-by-step state per key, and the stock after each event."""
    state, after = {}, {}
    for e in events:
        k = e["codigo_sku"]
        s = state.setdefault(k, dict(stock=(start or {}).get(k, 0), ventas=0, precio=0.0, hist=[], modelo="", estado="ACTIVE"))
        s["modelo"] = s["modelo"] or e["modelo"]
        s["estado"] = e["estado"] or s["estado"]
        if e["tipo_evento"] == "INVENTORY":
            s["stock"] = e["value"]
        elif e["tipo_evento"] == "TRANSIT":
            s["stock"] += e["value"]
        else:
            s["ventas"] += e["value"]
            s["stock"] = max(0, s["stock"] - e["value"])
            s["hist"] = (s["hist"] + [e["value"]])[-13:]
            s["precio"] = e["precio_unitario"] or s["precio"]
        after[e["evento_id"]] = (s["stock"], s["ventas"])
    return state, after


def as_dict(df):
    return {r.codigo_sku: dict(stock=r.stock, ventas=r.ventas, precio=r.precio, hist=list(r.historial), modelo=r.modelo,
                               estado=r.estado) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fold_equals_steps_for_any_split(spark, parts):
    events = random_events(210, parts)
    want, _ = stepwise(events)
    state = fold.empty_state(spark)
    size = len(events) // parts
    for i in range(parts):
        state = spark.createDataFrame(
            fold.folded(state, frame(spark, events[i * size:(i + 1) * size])).collect(), fold.STATE_SCHEMA)
    assert as_dict(state) == want


def test_replay_equals_steps_with_arrivals_and_start(spark):
    events = random_events(400, 5, ("SALES", "SALES", "SALES", "INVENTORY", "TRANSIT"))
    start = {"hot": 50, "a": 3, "b": 0}
    _, want = stepwise(events, start)
    initial = spark.createDataFrame([("PY", k, v) for k, v in start.items()], "pais string, codigo_sku string, stock bigint")
    got = {r.evento_id: (r.stock, r.ventas_acum) for r in replay.replayed(frame(spark, events), initial).collect()}
    assert got == want


def test_recent_demand_by_cumulative_sums(spark):
    events = random_events(150, 9)
    got = {r.evento_id: r.dem_hist for r in replay.with_recent_demand(replay.replayed(frame(spark, events))).collect()}
    sold = {}
    for e in events:
        h = sold.setdefault(e["codigo_sku"], [])
        if e["tipo_evento"] == "SALES":
            h.append(e["value"])
        assert got[e["evento_id"]] == pytest.approx(sum(h[-4:]) / len(h[-4:]) if len(h) >= 2 else 0)


def write_lines(folder, name, events, extra=()):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(e, default=lambda d: d.isoformat()) for e in events] + list(extra)
    (folder / name).write_text("\n".join(lines) + "\n")


def run_accounts(spark, folder, out, check):
    stream = ev.once(ev.valid_events(ev.line_stream(spark, str(folder))), "10 days")

    def store(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/lote={batch_id}")

    stock_accounts(stream).writeStream.foreachBatch(store).outputMode("update").option(
        "checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(out))
    fields = [c for c in rows.columns if c not in ("pais", "codigo_sku", "lote")]
    return rows.groupBy("pais", "codigo_sku").agg(F.max_by(F.struct(*fields), "lote").alias("s")).select("pais", "codigo_sku", "s.*")


def test_late_events_are_kept_unless_a_delay_is_set(spark, tmp_path):
    topic = tmp_path / "topic"
    new, late = random_events(2, 3), random_events(1, 4)
    for i, e in enumerate([*new, *late]):
        e |= {"evento_id": f"e{i}", "timestamp": datetime(2024, 3, 1 if i == 2 else 20 + i)}
    for i, part in enumerate(([new[0]], [new[1]], late, [new[0]])):
        write_lines(topic, f"{i}.jsonl", part)
        os.utime(topic / f"{i}.jsonl", (1_700_000_000 + i,) * 2)

    def ids(delay, name):
        stream = ev.once(ev.valid_events(ev.line_stream(spark, str(topic))), delay)
        stream.select("evento_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-check")).option(
            "path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / name)).collect())

    assert ids(None, "all") == ["e0", "e1", "e2"]
    assert ids("1 hour", "bounded") == ["e0", "e1"]


def test_stream_state_survives_restart_bad_lines_and_repeats(spark, tmp_path):
    events = random_events(120, 11)
    topic, out, check = tmp_path / "topic", tmp_path / "out", tmp_path / "check"
    write_lines(topic, "a.jsonl", events[:50], ['{"evento_id": "broken', "", '{"evento_id": "x"}'])
    run_accounts(spark, topic, out, check)
    write_lines(topic, "b.jsonl", events[40:])  # ten events come again
    got = as_dict(run_accounts(spark, topic, out, check))
    want, _ = stepwise(events)
    assert got == want
    lines = spark.read.text(str(topic))
    assert ev.quarantined(lines).count() == 2


def test_five_minute_windows_on_a_stream(spark, tmp_path):
    events = [event(i, value=2, price=1.5) for i in range(60)]
    write_lines(tmp_path / "t", "a.jsonl", events)
    stream = ev.per_five_minutes(ev.valid_events(ev.line_stream(spark, str(tmp_path / "t"))))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(rows) == 9 and all((r.eventos, r.unidades, r.ingreso) == (5, 10, 15.0) for r in rows)
    assert ev.per_five_minutes(frame(spark, events)).count() == 12


def state_row(sku, stock=0, ventas=0, hist=(), estado="ACTIVE", coming=(), precio=1.0, modelo="M", familia="F", marca="A",
              tier="LOW", sin_venta=0, pais="PY"):
    return (pais, sku, familia, modelo, marca, tier, estado, stock, ventas, precio, list(hist), 0, sin_venta, list(coming))


def states(spark, rows):
    return spark.createDataFrame(rows, fold.STATE_SCHEMA)


def test_alerts_at_their_bounds(spark):
    df = states(spark, [
        state_row("stockout", 0, 5), state_row("nothing", 0, 0), state_row("eol", 0, 5, estado=" eol "),
        state_row("doh7", 7, 30), state_row("doh69", 69, 300), state_row("doh90", 90, 0, [7, 7]),
        state_row("doh91", 91, 0, [7, 7]), state_row("thin", 9, 0, [0, 1]), state_row("soon", 60, 0, [7, 7], coming=[(9, 61)]),
        state_row("cover120", 60, 0, [7, 7], coming=[(9, 60)]), state_row("peak", 1000, 40, [1, 2, 3, 2]),
        state_row("flat", 10**6, 40, [2, 2, 2])])
    got = {}
    for r in rules.alerts(rules.kpis(df)).collect():
        got.setdefault(r.codigo_sku, []).append((r.tipo_alerta, r.detalle))
    assert got.pop("stockout") == [("STOCKOUT", "Stock = 0 con 5 uds vendidas")]
    assert got.pop("doh69") == [("DOH_BAJO", "DOH = 6.9 dias (umbral: 7)")]
    assert got.pop("doh91") == [("SOBRESTOCK", "DOH = 91 dias | dem. semanal ref: 7.0 uds")]
    assert got.pop("soon") == [("SOBRESTOCK", "Cobertura futura 121 dias (stock+tránsito=121 uds)")]
    peak = dict(got.pop("peak"))
    assert peak["PICO_DEMANDA"] == "Ventas 40 uds -- promedio historico 2.0 uds (+1900%)"
    assert [k for k, _ in got.pop("flat")] == ["SOBRESTOCK"]
    assert got == {}
    kpi = {r.codigo_sku: r for r in rules.kpis(df).collect()}
    assert (kpi["nothing"].doh, kpi["doh7"].doh, kpi["doh90"].doh) == (999, 7, 90)


def test_cover_shortfall_needs_stock_and_forecast(spark):
    kpi = rules.kpis(states(spark, [state_row("x", 5, 0)]))
    cols = "pais string, codigo_sku string, marca string, modelo string, stock_actual bigint, demanda_pred_7d double, cobertura_ok boolean"
    preds = spark.createDataFrame([("PY", "x", "A", "M", 5, 9.0, False), ("PY", "y", "A", "M", 0, 9.0, False),
                                   ("PY", "z", "A", "M", 9, 9.0, True)], cols)
    assert [(r.codigo_sku, r.tipo_alerta, r.detalle) for r in rules.alerts(kpi, preds).collect()] == [
        ("x", "COBERTURA_INSUFICIENTE", "Stock 5 uds -- demanda predicha 9.0 uds proxima semana")]


def test_order_quantity(spark):
    cases = [(s, d, c) for s in (0, 1, 7, 100) for d in (0.0, 0.2, 3.0, 10.5) for c in (0, 5, 90)]
    df = spark.createDataFrame(cases, "s bigint, d double, c bigint")
    for r in df.withColumn("q", rules.order_quantity(F.col("s"), F.col("d"), F.col("c"))).collect():
        target = r.d * 4
        left = max(0, r.s - max(1, r.d * 5 / 201600))
        want = 0 if r.d <= 0 else min(max(0, int(target - left - r.c)), int(target * 2))
        assert r.q == want, r


def test_orders_skip_open_transits_and_zero_quantities(spark):
    df = states(spark, [state_row("open", 0, 9, [5, 5, 5, 5], coming=[(8, 3)]), state_row("need", 0, 9, [5, 5, 5, 5]),
                        state_row("short", 0, 9, [5])])
    alerts = rules.alerts(rules.kpis(df))
    orders = {r.codigo_sku: r for r in rules.transit_orders(df, alerts, None, 3).collect()}
    assert set(orders) == {"need", "short"}
    assert (orders["need"].cantidad_sugerida, orders["need"].demanda_semanal, orders["need"].ventana_llegada) == (20, 5.0, 8)
    assert orders["short"].cantidad_sugerida == 4  # too little history counts as one unit a week
    listed = rules.with_new_transits(df, spark.createDataFrame(list(orders.values())))
    got = {r.codigo_sku: [tuple(x) for x in r.en_camino] for r in listed.collect()}
    assert got == {"open": [(8, 3)], "need": [(8, 20)], "short": [(8, 4)]}
    later = {r.codigo_sku: (r.stock, len(r.en_camino)) for r in rules.arrivals(listed, 8).collect()}
    assert later == {"open": (3, 0), "need": (20, 0), "short": (4, 0)}


def test_substitutes_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [state_row(f"s{i}", hist=[rnd.randint(0, 9) for _ in range(rnd.randint(0, 6))], modelo=f"M{rnd.randint(0, 5)}",
                      familia=rnd.choice(["", "F", "G"]), marca=rnd.choice("AB"), tier=rnd.choice(["LOW", "HIGH"]),
                      pais=rnd.choice(["PY", "NI"])) for i in range(40)] + [state_row("alone", hist=[1, 2], marca="Z")]
    df = states(spark, rows)
    got = {r.codigo_sku: (r.sku_sustituto, r.nivel_busqueda, r.dem_sustituto) for r in rules.substitutes(df, df).collect()}

    def search(t, family):
        best = []
        for c in rows:
            if (c[0], c[4], c[5]) != (t[0], t[4], t[5]) or c[1] == t[1] or (family and t[2] and c[2] != t[2]):
                continue
            h = c[10][-4:]
            if h and sum(h) > 0:
                best.append((c[3], round(sum(h) / len(h) * 10) / 10, c[1]))
        best.sort(key=lambda x: x[2])
        best.sort(key=lambda x: x[:2], reverse=True)
        return best[0] if best else None

    for t in rows:
        hit, level = search(t, True), 1
        if hit is None:
            hit, level = search(t, False), 2
        want = (hit[2], level, hit[1]) if hit else ("SIN_SUSTITUTO", 0, 0.0)
        assert got[t[1]] == want, t


def test_idle_keys_get_a_substitute_once(spark):
    df = states(spark, [state_row("idle", sin_venta=4), state_row("longer", sin_venta=5), state_row("eol", sin_venta=4, estado="EOL"),
                        state_row("good", hist=[3, 3, 3, 3])])
    got = rules.substitute_orders(df).collect()
    assert [(r.codigo_sku, r.sku_sustituto, r.motivo) for r in got] == [("idle", "good", "4 ventanas sin movimiento")]


def test_idle_counter_variants(spark):
    state = states(spark, [state_row("1", 5, 3, [3], sin_venta=2)])
    batch = frame(spark, [event(1, "INVENTORY", "2", 5)])
    window = {r.codigo_sku: r.sin_venta for r in fold.folded(state, batch).collect()}
    total = {r.codigo_sku: r.sin_venta for r in fold.folded(state, batch, idle="cumulative").collect()}
    assert window == {"1": 3, "2": 1} and total == {"1": 0, "2": 1}


def test_job_is_repeatable_and_feeds_the_dashboard(spark, tmp_path):
    folder = str(tmp_path / "job")
    job = StreamJob(spark, folder)
    batches = [[event(1, "INVENTORY", "1", 2), event(2, "SALES", "1", 3)], [event(3, "INVENTORY", "2", 50)],
               [event(4, "SALES", "2", 1)]]
    for i, b in enumerate(batches):
        job.process(frame(spark, b), i)
    before = sorted(map(str, job.table("estado").drop("timestamp").collect()))
    job.process(frame(spark, batches[1]), 1)
    job.process(frame(spark, batches[2]), 2)
    assert sorted(map(str, job.table("estado").drop("timestamp").collect())) == before
    assert job.table("kpis").groupBy("ventana").count().count() == 3
    orders = job.table("ordenes").collect()
    assert [(o.codigo_sku, o.ventana, o.cantidad_sugerida, o.ventana_llegada) for o in orders] == [("1", 1, 4, 6)]
    job.process(frame(spark, [event(5, "SALES", "2", 1)]), 3)
    job.process(frame(spark, [event(6, "SALES", "2", 1)]), 4)
    job.process(frame(spark, [event(7, "SALES", "2", 1)]), 5)
    last = {r.codigo_sku: r.stock for r in job.table("estado").filter("ventana = 6").collect()}
    assert last == {"1": 4, "2": 46}
    summary = {r.ventana: (r.skus, r.en_stockout) for r in dashboard.window_summary(job.table("kpis")).collect()}
    assert summary[1] == (1, 1) and summary[3] == (2, 1)


def test_events_from_table_and_back(spark, tmp_path):
    fact = spark.createDataFrame(
        [("SALES", "PY", "1", T0.date(), 3.0, 2.555, 7.0, "EOL"), ("SALES", "PY", "2", T0.date(), 3.0, 2.0, 7.0, None)],
        "TIPO_TRANSACCION string, PAIS string, CODIGO_SKU string, FECHA date, VALUE double, PRECIO_UNITARIO double, COSTO double, ESTADO string")
    events = ev.table_events(fact, "SALES")
    assert [r.codigo_sku for r in events.collect()] == ["2"]  # a discontinued SKU does not sell
    ev.export_lines(events, str(tmp_path / "x"), 2)
    back = ev.valid_events(spark.read.text(str(tmp_path / "x"))).collect()
    assert [(r.value, r.precio_unitario, r.estado, r.fuente) for r in back] == [(3, 2.0, "ACTIVE", "REAL")]


def test_window_totals_equal_keys_times_windows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        kind = rng.choice(["SALES", "SALES", "SALES", "INVENTORY"])
        rows.append((f"e{i:04d}", datetime(2024, 1, 1) + timedelta(minutes=i), kind, "A", f"s{min(rng.randrange(12), rng.randrange(12))}", rng.randrange(1, 9), 2.5, i // 20 + 1))
    events = spark.createDataFrame(rows, "evento_id string, timestamp timestamp, tipo_evento string, pais string, codigo_sku string, value long, precio_unitario double, ventana long")
    events = events.withColumns({c: F.lit("x") for c in ("familia", "modelo", "marca", "tier")} | {"estado": F.lit("ACTIVE")})
    states = rules.kpis(replay.window_states(replay.replayed(events))).cache()
    sales = {}
    for _, _, kind, _, sku, value, _, window in rows:
        if kind == "SALES":
            sales.setdefault(sku, []).append((window, value))
    for r in states.collect():
        assert r["historial"] == [v for w, v in sales.get(r["codigo_sku"], []) if w <= r["ventana"]][-13:]
    every = replay.in_every_window(states, F.lit(20)).cache()
    first = {r[4]: r[7] for r in reversed(rows)}
    assert every.count() == sum(21 - w for w in first.values())
    def shown(df):
        return sorted((r["ventana"], r["skus"], r["con_ventas"], r["en_stockout"], r["ventas"], round(r["ingreso"], 6), None if r["doh_prom"] is None else round(r["doh_prom"], 6)) for r in df.collect())

    assert shown(dashboard.window_totals(states)) == shown(dashboard.window_summary(every))


def test_lowest_hashes_are_those_of_the_whole_order(spark):
    rows = spark.range(20_000).select((F.col("id") % 9000).alias("a"), F.lit("x").alias("b"))
    whole = rows.withColumn("h", F.xxhash64(F.lit(7), "a", "b")).orderBy("h", "a").drop("h")
    for n in (1, 500, 19_999, 20_000, 50_000):
        got = sorted(r.a for r in ev.lowest_hashes(rows, n, 7).collect())
        assert got == sorted(r.a for r in whole.limit(n).collect()), n
    same = spark.range(3000).select(F.lit(1).alias("a"))  # all rows share one hash
    assert ev.lowest_hashes(same, 10).count() == 10
    assert ev.lowest_hashes(same.limit(0), 10).count() == 0 and ev.lowest_hashes(same, 0).count() == 0


def test_a_batch_export_is_many_files_of_the_whole_order(spark, tmp_path):
    events = frame(spark, [event(i) for i in range(200)])
    ev.export_lines(events, str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("part-*.txt"))) > 1
    back = ev.valid_events(spark.read.text(str(tmp_path / "x")))
    assert sorted(r.evento_id for r in back.collect()) == [f"e{i:06d}" for i in range(200)]


def test_a_compressed_export_has_the_same_lines_in_the_same_order(spark, tmp_path):
    events = frame(spark, [event(i) for i in range(200)])
    ev.export_lines(events, str(tmp_path / "plain"))
    ev.export_lines(events, str(tmp_path / "small"), compression="gzip")

    def lines(name):
        files = sorted((tmp_path / name).glob("part-*"), key=lambda f: f.name[:10])
        return [[r.value for r in spark.read.text(str(f)).collect()] for f in files]

    assert lines("small") == lines("plain") and len(list((tmp_path / "small").glob("part-*.txt.gz"))) > 1
    sizes = [sum(f.stat().st_size for f in (tmp_path / name).glob("part-*")) for name in ("small", "plain")]
    assert sizes[0] < sizes[1] / 3


def test_windows_of_one_long_state_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(replay, "STRETCH", 10)
    rows = [("PY", "1", 3, None), ("PY", "2", 1, 1), ("PY", "2", 2, 95)]
    states = spark.createDataFrame(rows, "pais string, codigo_sku string, ventana bigint, hasta bigint").coalesce(1)
    out = replay.in_every_window(states, F.lit(100).cast("bigint"))
    got = sorted((r.codigo_sku, r.ventana) for r in out.collect())
    assert got == sorted([("1", w) for w in range(3, 101)] + [("2", w) for w in range(1, 96)])
    assert out.filter("codigo_sku = '1'").groupBy(F.spark_partition_id()).count().count() > 1


def test_rows_of_all_windows_come_by_stretch_key_and_window(spark, monkeypatch):
    monkeypatch.setattr(replay, "STRETCH", 8)
    rows = [("PY", f"{k}", w, None if w + step > 40 else w + step - 1) for k, step in enumerate((3, 7, 11, 40), 1)
            for w in range(k, 41, step)]
    states = spark.createDataFrame(rows, "pais string, codigo_sku string, ventana bigint, hasta bigint")
    out = replay.in_every_window(states, F.lit(40).cast("bigint"))
    got = out.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "codigo_sku", "ventana").orderBy("i").collect()
    assert sorted((r.codigo_sku, r.ventana) for r in got) == [(str(k), w) for k in range(1, 5) for w in range(k, 41)]
    for task in {r.p for r in got}:
        order = [((r.ventana - 1) // 8, r.codigo_sku, r.ventana) for r in got if r.p == task]
        assert order == sorted(order)
    pieces = {(r.p, r.codigo_sku, (r.ventana - 1) // 8) for r in got}
    assert len(pieces) == len({p[1:] for p in pieces})  # a key's stretch is in one task


def test_keys_of_a_bucket_share_one_state_value():
    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, value):
            calls.append("update")
            kept["v"] = value

    processor = state.StockProcessor(2)
    processor.init(SimpleNamespace(getValueState=lambda *_: Value()))
    row = Row(*state.FIELDS)

    def rows(*events):
        return iter([row("PY", sku, at, f"e{at}", kind, units, 1.5, "", "M", "A", "LOW", None) for sku, at, kind, units in events])

    first = list(processor.handleInputRows((0,), rows(("1", 2, "SALES", 3), ("2", 1, "INVENTORY", 9), ("1", 1, "INVENTORY", 5)), None))
    assert [(r.codigo_sku, r.stock, r.ventas, r.historial, r.eventos, r.ultimo) for r in first] == [
        ("1", 2, 3, [3], 2, 2), ("2", 9, 0, [], 1, 1)]
    second = list(processor.handleInputRows((0,), rows(*[("2", at, "SALES", at) for at in (4, 3, 5)]), None))
    assert [(r.codigo_sku, r.stock, r.ventas, r.historial) for r in second] == [("2", 0, 12, [4, 5])]
    assert calls == ["get", "update"] * 2 and kept["v"][1] == ["1", "2"]


def test_a_long_batch_of_a_stream_is_several_files(spark, tmp_path):
    events = ev.with_count_window(frame(spark, [event(i) for i in range(90)]), 30, "lote")
    files = ev.export_batches(events, str(tmp_path / "t"), "lote", [1, 2, 3], rows_per_file=8)
    seen = []
    stream = ev.valid_events(ev.line_stream(spark, str(tmp_path / "t"), files))
    stream.writeStream.foreachBatch(lambda df, i: seen.append(df.agg(F.count("*"), F.min("evento_id")).first())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "t").glob("part-*.txt"))) == 3 * files == 12
    assert [tuple(r) for r in seen] == [(30, "e000000"), (30, "e000030"), (30, "e000060")]
    assert ev.export_batches(events, str(tmp_path / "short"), "lote", [3, 4], rows_per_file=8) == 1  # number 4 has no rows
