"""The shared test tables seen as logs and as landed requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import with_attributes
from ..functions.isotime import iso_micros_text
from ..schema import LOG_COLUMNS

# ``ts`` holds UTC instants without a zone; read as TIMESTAMP it keeps its
# value and time filters reach the scan without a cast in between.
_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, props string"
_ITEMS_PER_REQUEST = 100


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as records with ids."""
    events = spark.read.schema(_EVENTS).parquet(f"{folder}/events.parquet")
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "error").when(kind == "purchase", "warn")
        .when(kind == "view", "debug").otherwise("info")
    )
    user = F.col("user_id")
    return with_attributes(events, F.try_parse_json("props")).select(
        (F.col("event_id") + 1).alias("id"),
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (user % 8).cast("string")).alias("service"),
        F.concat(kind, F.lit(" by user_"), user.cast("string"), F.lit(" at 50% "), "props").alias("message"),
        "attributes",
        "attributes_json",
    )


def document_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as records: whole texts as messages."""
    documents = spark.read.schema(
        "doc_id long, text string, lang string, source string, n_chars long"
    ).parquet(f"{folder}/documents.parquet")
    seconds = F.lit(1_704_067_200) + F.col("doc_id") * 37  # from 2024-01-01
    count = F.col("n_chars").cast("string")
    return documents.select(
        (F.col("doc_id") + 1).alias("id"),
        F.timestamp_seconds(seconds).alias("timestamp"),
        F.lit("info").alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), count).alias("attributes"),
        F.concat(
            F.lit('{"lang":'), _quoted(F.col("lang")), F.lit(',"n_chars":'), count, F.lit("}")
        ).alias("attributes_json"),
    )


def event_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every event packed into JSON request bodies, some items damaged on purpose."""
    logs = event_logs(spark, folder)
    number = F.col("id") - 1
    case = number % 50
    text = {
        "timestamp": F.when(case == 7, "not-a-date").otherwise(iso_micros_text(F.col("timestamp"))),
        "level": F.when(case.isin(11, 31), "critical").otherwise(F.col("level")),
        "service": F.when(case == 17, "").otherwise(F.col("service")),
        "message": F.when(case == 31, "").otherwise(F.col("message")),
    }
    member = {name: F.concat(F.lit(f'"{name}":'), _quoted(value)) for name, value in text.items()}
    member["level"] = F.when(case != 13, member["level"])
    member["message"] = F.when(case == 19, '"message":5').otherwise(member["message"])
    member["attributes"] = F.when(case == 23, '"attributes":{"nested":{}}').when(
        case != 29, F.concat(F.lit('"attributes":'), "attributes_json")
    )
    item = F.when(case == 3, "5").otherwise(
        F.concat(F.lit("{"), F.concat_ws(",", *member.values()), F.lit("}"))
    )
    items = logs.select(
        F.floor(number / _ITEMS_PER_REQUEST).cast("string").alias("request_id"),
        F.struct(number.alias("number"), item.alias("item")).alias("entry"),
    )
    in_order = F.array_sort(F.collect_list("entry"))["item"]
    return items.groupBy("request_id").agg(
        F.concat(F.lit('{"logs":['), F.array_join(in_order, ","), F.lit("]}")).alias("body")
    ).select("request_id", "body", F.to_timestamp(F.lit("2024-02-01T00:00:00Z")).alias("received_at"))


def unnumbered(logs: DataFrame) -> DataFrame:
    """Records as they are before the table gives them ids."""
    return logs.select(*LOG_COLUMNS)
