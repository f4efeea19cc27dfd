from . import attribution, cohorts, cubes, kpi, quality, segments, trends

__all__ = ["attribution", "cohorts", "cubes", "kpi", "quality", "segments", "trends"]
