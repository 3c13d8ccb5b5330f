"""What a language model may be asked: spellings of places, words for a contradiction. It never decides.

A client is any function from a list of questions to a list of answers (text or
None); it is made once a partition. Every different question is asked once over
the whole table. A client that fails answers nothing here: the place stays by
itself, the contradiction keeps its rule's words. Only extraction fails its task
(operators/extraction).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.functions import vocab as V

Client = Callable[[list[str]], list[str | None]]

# How much of a question a model sees, and the forms of its answers.
MOST_CANDIDATES, CANDIDATE_CHARS, MENTION_CHARS = 6, 80, 120
PLACE_ANSWER, CONFLICT_ANSWER = r'place:\s*"([^"]*)"', r'conflict:\s*"([^"]*)"'


def wire_form() -> re.Pattern:
    """The form that every wire text of an extractor must have: fixed fields in fixed order, types and severities of the vocabularies."""
    quoted, kinds, levels = r'(?:"(?:[^"]|"")*"|null)', "|".join(V.EVENT_TYPES), "|".join(V.SEVERITIES)
    event = rf"\{{type:(?:{kinds}),location:{quoted},people:(?:[0-9]{{1,4}}|null),severity:(?:{levels}),time:{quoted},desc:{quoted}\}}"
    return re.compile(rf"events:\[(?:{event}(?:,{event})*)?\]")


#: What an answer to the other two questions must look like.
PLACE_FORM = re.compile(r'place:"[a-zA-Z0-9 _؀-ۿ.\-]+"')
CONFLICT_FORM = re.compile(r"conflict:\"[a-z0-9 ,.']{20,150}\"")


def held(c: Column, form: re.Pattern) -> Column:
    """Does the whole answer have the form?"""
    return F.coalesce(c.rlike(f"^(?:{form.pattern})$"), F.lit(False))


def asked(questions: DataFrame, make: Callable[[], Client]) -> DataFrame:
    """question, answer of each different question (one column `question`); null where the client fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for b in batches:
            texts = b.column(0).to_pylist()
            try:
                client = client or make()
                answers = client(texts)
            except Exception:  # an unreachable model is no licence to guess
                answers = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string())], names=["question", "answer"])

    return questions.where("question IS NOT NULL").select("question").distinct().mapInArrow(run, "question string, answer string")


def health(make: Callable[[], Client], question: str = "ping") -> dict:
    """Whether a client answers; never raises."""
    try:
        return {"available": make()([question])[0] is not None}
    except Exception as e:
        return {"available": False, "error": type(e).__name__}


def explained(conflicts: DataFrame, make: Callable[[], Client]) -> DataFrame:
    """conflicts (side_a, side_b, conflict_type, explanation) with the model's words where it has some, else the rule's."""
    q = conflicts.withColumn("question", F.concat(F.lit("field: "), "conflict_type", F.lit("\nfirst: "), "side_a", F.lit("\nsecond: "), "side_b"))
    said = asked(q.select("question"), make).select("question", F.nullif(F.regexp_extract("answer", CONFLICT_ANSWER, 1), F.lit("")).alias("_said"))
    return q.join(said, "question", "left").withColumn("explanation", F.coalesce("_said", "explanation")).select(*conflicts.columns)


def proposed(mentions: DataFrame, known: DataFrame, aliases: DataFrame, make: Callable[[], Client], compatibility: bool = True) -> DataFrame:
    """mention, canonical, same, confidence, reason: the model's spelling of each mention that no known place (column canonical) equals.

    The model is shown the first known places; what it names is looked up among
    all of them. It merges a mention with one only if they share a content word
    or an alias group (name, group_id).
    """
    m = mentions.where("mention IS NOT NULL").select("mention", X.place_name(F.col("mention"), compatibility).alias("key")).distinct()
    k = known.where("canonical IS NOT NULL").groupBy(X.place_name(F.col("canonical"), compatibility).alias("key")).agg(F.min("canonical").alias("canonical")).where(~X.is_generic(F.col("key")))
    shown = [r.canonical[:CANDIDATE_CHARS] for r in k.orderBy("canonical").limit(MOST_CANDIDATES).collect()]
    j = m.join(k.withColumnRenamed("canonical", "equal"), "key", "left").withColumn("generic", X.is_generic(F.col("key")))
    question = F.concat(F.lit("known places: " + " OR ".join(shown) + "\nnew place: "), F.substring("mention", 1, MENTION_CHARS))
    j = j.withColumn("question", F.when(~F.col("generic") & F.col("equal").isNull() & F.lit(bool(shown)), question))
    said = asked(j.select("question"), make).select("question", F.nullif(F.trim(F.regexp_extract("answer", PLACE_ANSWER, 1)), F.lit("")).alias("said"))
    j = j.join(said, "question", "left").withColumn("said_key", X.place_name(F.col("said"), compatibility))
    j = j.join(k.select(F.col("key").alias("said_key"), F.col("canonical").alias("match")), "said_key", "left")
    g = aliases.where("name IS NOT NULL").groupBy(X.place_name(F.col("name"), compatibility).alias("k")).agg(F.collect_set("group_id").alias("groups"))
    j = j.join(g.select(F.col("k").alias("key"), F.col("groups").alias("own")), "key", "left").join(g.select(F.col("k").alias("said_key"), F.col("groups").alias("theirs")), "said_key", "left")
    support = F.arrays_overlap(X.content_tokens(F.col("key")), X.content_tokens(F.col("said_key"))) | F.coalesce(F.arrays_overlap("own", "theirs"), F.lit(False))
    reason = (
        F.when(F.col("generic"), "generic_or_empty").when(F.lit(not shown), "first_mention").when(F.col("equal").isNotNull(), "exact_normalized_match").when(F.col("said").isNull(), "model_unavailable")
        .when(F.col("match").isNull(), "name_is_new").when(support, "name_with_lexical_support").otherwise("merge_without_lexical_support")
    )
    j = j.withColumn("reason", reason)
    r = F.col("reason")
    canonical = F.when(r == "exact_normalized_match", F.col("equal")).when(r == "name_is_new", F.col("said")).when(r == "name_with_lexical_support", F.col("match")).otherwise(F.col("mention"))
    same = F.when(r.isin("exact_normalized_match", "name_with_lexical_support"), F.lit(True)).when(r.isin("name_is_new", "merge_without_lexical_support"), F.lit(False))
    sure = F.when(r.isin("exact_normalized_match", "first_mention"), 1.0).when(r == "name_with_lexical_support", 0.7).otherwise(0.0)
    return j.select("mention", canonical.alias("canonical"), same.alias("same"), sure.alias("confidence"), "reason")
