"""slicewise: KPI time-series analytics for radio cells, written as Spark jobs."""
