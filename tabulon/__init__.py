"""tabulon: understanding, preparing and modelling tables as Spark plans."""

__version__ = "0.1.0"
