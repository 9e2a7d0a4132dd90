"""Public conversation benchmarks in JSON as turn and question tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QA = "array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
_TURNS = "array<struct<speaker:string,dia_id:string,text:string>>"


def session_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of files that hold a list of samples with session_N turn lists, session_N_date_time and qa.

    turns: conv, session, session_date, dia_id, speaker, text. questions: conv, question, answer, category, evidence.
    """
    raw = spark.read.schema(f"sample_id string, conversation map<string,string>, qa {_QA}").option("multiLine", "true").json(path)
    parts = raw.select(F.col("sample_id").alias("conv"), "conversation", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    turns = parts.select("conv", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), F.col("conversation")[F.concat("key", F.lit("_date_time"))].alias("session_date"), F.inline(F.from_json("value", _TURNS)))
    questions = raw.select(F.col("sample_id").alias("conv"), F.inline("qa"))
    return turns.select("conv", "session", "session_date", "dia_id", "speaker", "text"), questions


def haystack_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of files that hold a list of questions, each with its own haystack of sessions."""
    schema = "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    sessions = raw.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session", "s"))
    turns = sessions.select("question_id", "session", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return turns.select("question_id", "session", "session_id", "date", "turn", "t.role", "t.content"), raw.drop("haystack_sessions", "haystack_dates", "haystack_session_ids")
