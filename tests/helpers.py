"""Small tables out of rows."""


def frame(spark, columns, rows):
    """columns: "name:s other:i" (s string, i int, l long, d double, b boolean); an ordinal column keeps the rows' order."""
    kinds = {"s": "string", "i": "int", "l": "long", "d": "double", "b": "boolean"}
    schema = ", ".join(f"{n} {kinds[k]}" for n, _, k in (c.partition(":") for c in columns.split()))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", _ord long")


def by(df, key):
    return {r[key]: r for r in df.collect()}


ENT = "lei:s legal_name:s country_legal:s"
REL = "source_lei:s target_lei:s relationship_type:s"
