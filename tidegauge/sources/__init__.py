from tidegauge.sources import tables

__all__ = ["tables"]
