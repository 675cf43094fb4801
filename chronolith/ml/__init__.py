"""Predictor contract, evaluation and training."""
