from featuremart.sources.tables import SourceTables
from featuremart.sources.scans import Days, day_scan, range_scan, shift_day

__all__ = ["Days", "SourceTables", "day_scan", "range_scan", "shift_day"]
