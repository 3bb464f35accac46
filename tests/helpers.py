import datetime as dt

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def series(spark, rows, name="a", obstype="temp"):
    """Observations of one series from (minutes, value)."""
    return spark.createDataFrame([(name, obstype, at(m), None if v is None else float(v)) for m, v in rows], "name string, obstype string, datetime timestamp, value double")


def minutes(df, column="datetime"):
    return sorted(int((r[column] - START).total_seconds() // 60) for r in df.select(column).collect())
