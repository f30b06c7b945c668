from tidegauge.functions import columns

__all__ = ["columns"]
