"""Lakeloom: language-model data preparation and analysis as DataFrame plans."""

__version__ = "0.1.0"
