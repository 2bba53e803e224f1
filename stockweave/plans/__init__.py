"""Analytic plans: each function takes and returns DataFrames. The Pareto, the batch view and the clean fact
also write intermediates to the shared folder while they are planned; the model fits run jobs."""
