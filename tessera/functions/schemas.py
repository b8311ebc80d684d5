"""Canonical table schemas, and conforming a table to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns(text: str) -> T.StructType:
    """A schema from `name:kind` words: s text, i int, l long, d double, b boolean."""
    return T.StructType([T.StructField(n, {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}[k]) for n, _, k in (x.partition(":") for x in text.split())])


ENTITY = columns("lei:s legal_name:s other_names:s transliterated_other_names:s category:s legal_form:s entity_status:s registered_at:s last_update_at:s country_legal:s city_legal:s country_hq:s city_hq:s")
RELATIONSHIP = columns("source_lei:s target_lei:s relationship_type:s relationship_status:s accounting_standard:s period_end:s valid_from:s valid_to:s")
SEARCH = columns("query:s rank:i lei:s legal_name:s country_legal:s country_hq:s category:s entity_status:s registration_status:s total_results:i")
EXCEPTION = columns("lei:s exception_reason:s exception_reference:s")
ADDRESS = columns("lei:s address_line1:s address_line2:s city:s region:s postal_code:s country:s")
CLUSTER = columns("lei:s address_cluster_id:l cluster_size:l cluster_address_key:s is_office_hotel:b")
ADDRESS_INFERRED = columns("lei:s inferred_parent_lei:s inference_source:s confidence:d confidence_basis:s cluster_size:l is_office_hotel:b")
NAME_MATCH = columns("lei:s matched_parent_lei:s brand_token:s match_score:d match_field:s")
PREDICTION = columns("lei:s predicted_parent_country:s prediction_probability:d confidence_gap:d top3_countries:s top3_probabilities:s")
REGISTRY_MATCH = columns("lei:s legal_name:s ctos_name:s ctos_url:s ctos_registration_no:s ctos_match_score:d ctos_match_method:s ctos_registered_malaysia:i")
OVERRIDE = columns("active:s host_country:s lei:s legal_name:s uie_lei:s uie_name:s uie_country:s uie_source:s evidence_tier:s uie_confidence:s override_reason:s source_url:s source_note:s")
STATUS = columns("active:s host_country:s lei:s review_status:s entity_type:s review_note:s reviewed_at:s")
#: The order of rows that first-wins rules go by; tables without it are ordered by their key alone.
ORDINAL = "_ord"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: missing ones null, others dropped. The ordinal column stays if there is one."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols, *([ORDINAL] if ORDINAL in df.columns else []))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
