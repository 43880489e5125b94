"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quiremill", **conf: str) -> SparkSession:
    """UTC, adaptive plans. Names in conf use __ for dots: spark__sql__shuffle__partitions="400"."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def load_config(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """A JSON or YAML file of settings, by its ending, over defaults; nested settings are merged. Read through Spark, so that it can
    lie in any store."""
    import json

    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        given = yaml.safe_load(text)
    else:
        given = json.loads(text)

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return over(defaults or {}, given or {})
