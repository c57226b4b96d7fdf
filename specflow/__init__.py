"""specflow: spectral calibration analytics on Spark DataFrames.

Spectra, metadata and targets are DataFrames; preprocessing, folds,
metrics and model selection are joins, windows and aggregates; linear
models are solved from fold-keyed sufficient statistics gathered in one
distributed pass.
"""

__version__ = "0.1.0"
