"""Retrieval and answer quality: recall of expected chunks, token F1, judge scores."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import answer
from scriptorium.operators.ledger import Ledger
from scriptorium.sources import settings


def _given(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def chunk_recall(expected: Column, retrieved: Column) -> Column:
    """The share of expected ids that were retrieved; 1 if none is expected, 0 if none came."""
    e, r = _given(expected), _given(retrieved)
    return F.when(F.size(e) == 0, 1.0).when(F.size(r) == 0, 0.0).otherwise(F.size(F.array_intersect(e, r)) / F.size(e))


def n_common(a: Column, b: Column) -> Column:
    """How many words two lists share, each as often as both have it: one walk along the two in order."""

    def walk(z: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            x, y = F.get(z["a"], s["i"]), F.get(z["b"], s["j"])
            both = x.isNotNull() & y.isNotNull()
            return F.struct((s["i"] + (both & (x <= y)).cast("int")).alias("i"), (s["j"] + (both & (y <= x)).cast("int")).alias("j"), (s["n"] + (both & (x == y)).cast("int")).alias("n"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        return F.aggregate(F.concat(z["a"], z["b"]), start, step)["n"]

    ordered = F.array(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")))  # inside a lambda an outer expression would be computed at every step
    return F.element_at(F.transform(ordered, walk), 1)


def token_f1(predicted: Column, reference: Column) -> Column:
    """F1 of two texts' words, each as often as it occurs; 1 if both have none, 0 if one has none."""

    def f1(z: Column) -> Column:
        sizes = F.size(z["p"]) + F.size(z["r"])
        empty = (F.size(z["p"]) == 0) | (F.size(z["r"]) == 0)
        return F.when(empty, (sizes == 0).cast("double")).otherwise(2.0 * n_common(z["p"], z["r"]) / sizes)

    return F.element_at(F.transform(F.array(F.struct(T.tokens(predicted).alias("p"), T.tokens(reference).alias("r"))), f1), 1)


def report(samples: DataFrame) -> DataFrame:
    """``n_samples, mean_recall, mean_score`` over rows ``recall, score``."""
    return samples.agg(F.count("*").alias("n_samples"), F.avg("recall").alias("mean_recall"), F.avg("score").alias("mean_score"))


def judge_prompt(template: str, question: Column, expected: Column, predicted: Column) -> Column:
    """A template with its places ``{question}``, ``{expected_answer}`` and ``{predicted_answer}`` filled; doubled braces are single ones."""
    values = {"{question}": question, "{expected_answer}": expected, "{predicted_answer}": predicted}
    parts = re.split(r"(\{question\}|\{expected_answer\}|\{predicted_answer\})", template)
    filled = [F.coalesce(values[x], F.lit("")) if x in values else F.lit(x.replace("{{", "{").replace("}}", "}")) for x in parts if x]
    return F.concat(*filled) if filled else F.lit("")


def evaluated(answers: DataFrame, samples: DataFrame, judge: Callable[[Column, answer.Chat], Column] | None = None, key: str = "id", prompts_path: str | None = None, ledger: Ledger | None = None) -> DataFrame:
    """One record per sample: answers ``<key>, answer, retrieved`` against samples ``<key>, question, answer, references``.

    ``judge`` is a chat model (see ``answer.Models.generate``), asked at temperature 0; without one the score is the token F1.
    """
    gold = samples.select(key, "question", F.col("answer").alias("expected_answer"), F.transform("references", lambda x: x["chunk_id"]).alias("expected_chunks"))
    both = gold.join(answers.select(key, F.col("answer").alias("predicted_answer"), F.col("retrieved").alias("retrieved_chunks")), key, "left")
    if judge is None:
        verdict = F.struct(token_f1(F.col("predicted_answer"), F.col("expected_answer")).alias("score"), F.lit("token F1").alias("reasoning"))
    else:
        prompt = judge_prompt(settings.eval_prompt(prompts_path), F.col("question"), F.col("expected_answer"), F.col("predicted_answer"))
        chat = answer.Chat("judge", temperature=0.0)
        if ledger is None:
            verdict = T.judge_verdict(judge(answer.messages(prompt), chat)["content"])
        else:
            both = ledger.replies(both, "judge", answer.messages(prompt), lambda said: judge(said, chat).cast(answer.REPLY), asdict(chat))
            verdict = T.judge_verdict(F.col("reply.content"))
    both = both.select("*", F.explode(F.array(verdict)).alias("verdict"))  # behind a generator: the judge is asked once
    return both.select(
        F.col(key).alias("sample_id"), "question", "expected_answer", "predicted_answer", "expected_chunks", "retrieved_chunks",
        chunk_recall(F.col("expected_chunks"), F.col("retrieved_chunks")).alias("recall"),
        F.col("verdict.score").alias("score"), F.col("verdict.reasoning").alias("reasoning"),
    )


def run(samples: DataFrame, points: DataFrame, models: answer.Models | None = None, judge: Callable[[Column, answer.Chat], Column] | None = None, key: str = "id", **options) -> DataFrame:
    """Every sample's question asked (``options`` as of ``answer.answer``), and the answers evaluated."""
    found = answer.answer(samples.select(F.col(key).alias("query_id"), "question"), points, models, **options)
    retrieved = F.transform(F.coalesce("chunks", F.array().cast(found.schema["chunks"].dataType)), lambda c: c["chunk_id"])
    return evaluated(found.select(F.col("query_id").alias(key), "answer", retrieved.alias("retrieved")), samples, judge, key, ledger=options.get("ledger"))
