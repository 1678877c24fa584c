"""Question answering in batches: search, rerank, context, model, diagnostics. Models are injected; the defaults work offline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import batching, vectors
from scriptorium.operators.ledger import Ledger
from scriptorium.sources import settings, writers

# Fixed value: the default instruction of the model.
SYSTEM_PROMPT = "Отвечай только фактами из предоставленного контекста. Если информации недостаточно, честно скажи об этом. Всегда добавляй ссылки на источники в формате [номер]."


REPLY = "struct<content:string,model:string,prompt_tokens:int,completion_tokens:int,total_tokens:int>"


@dataclass(frozen=True)
class Chat:
    """What a model is asked with besides the messages; None leaves it to the model."""

    model: str = "first-passage"
    temperature: float | None = None
    max_tokens: int | None = None


def messages(prompt: Column, system: str | None = None) -> Column:
    """A conversation ``role, content``: the instruction, if there is one, and the question."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*([said("system", F.lit(system))] if system else []), said("user", prompt))


def reply(content: Column, chat: Chat, prompt_tokens: Column | None = None, completion_tokens: Column | None = None) -> Column:
    """A model's reply with its usage, null where the model tells none."""
    count = lambda c: (F.lit(None) if c is None else c).cast("int")
    used = count(prompt_tokens), count(completion_tokens)
    return F.struct(T.strip(content).alias("content"), F.lit(chat.model).alias("model"), used[0].alias("prompt_tokens"), used[1].alias("completion_tokens"), (used[0] + used[1]).alias("total_tokens"))


def first_passage(said: Column, chat: Chat) -> Column:
    """The default offline model: the first passage of the context, with its mark; tokens as ``text.count_tokens`` counts them."""
    last = F.element_at(said, -1)["content"]
    body = F.regexp_extract(last, r"(?s)\[1\] [^\n]*\n(.*?)(?=\n\n|\z)", 1)
    content = F.concat(T.truncate(body, 200), F.lit(" [1]"))
    tokens = F.aggregate(said, F.lit(0), lambda n, m: n + T.count_tokens(m["content"]))
    return reply(content, chat, tokens, T.count_tokens(content))


@dataclass(frozen=True)
class Models:
    """The seams for models: each is a function over columns, so a served model goes in as an Arrow function that loads it once.

    ``generate`` gets the messages (an array of ``role, content``) and the ``Chat`` settings, and returns what ``reply`` makes. ``embed`` turns a text into its vector; a model that takes many texts at a time goes in as ``embed_many``, from an array of
    texts to the array of their vectors, and gets them in requests of bounded size.
    """

    embed: Callable[[Column], Column] = vectors.hashed_embedding
    embed_many: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] = vectors.lexical_overlap
    generate: Callable[[Column, Chat], Column] = first_passage
    system_prompt: str = SYSTEM_PROMPT
    names: dict = field(default_factory=lambda: {"embedding": "hashed-words", "rerank": "lexical-overlap", "answer": "first-passage"})


def retrieve(questions: DataFrame, points: DataFrame, models: Models, k: int, rerank: bool = True, spec: dict | None = None, threshold: float | None = None) -> DataFrame:
    """Ranked chunks of every question: four times k candidates reranked to k, or the k nearest."""
    if models.embed_many is None:
        asked = questions.withColumn("query_vector", models.embed(F.col("question")))
    else:
        asked = embedded(questions, "query_id", "question", models.embed_many).withColumnRenamed("vector", "query_vector")
    kept = points.where(vectors.compile_filter(spec, points))
    found = vectors.batch_top_k(kept, asked.select("query_id", "query_vector"), 4 * k if rerank else k, threshold)
    if not rerank:
        return found.withColumn("vector_score", F.col("score")).withColumn("rerank_score", F.lit(None).cast("double")).drop("score")
    found = found.join(questions.select("query_id", "question"), "query_id")
    return vectors.rerank(found, models.rerank(F.col("question"), F.col("text")), k).drop("question")


def context(ranked: DataFrame, most: int = 1500) -> DataFrame:
    """``query_id, context, chunks``: the passages of each question in order of rank."""
    title = T.source_title(F.col("book_title"), F.col("chapter_title"), F.col("section_path"), F.col("chunk_id"))
    block = T.context_block(F.col("rank"), title, F.col("text"), most)
    entry = F.struct("rank", block.alias("block"), diagnostics().alias("chunk"))
    grouped = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))  # k passages a question
    return grouped.select("query_id", F.array_join(F.transform("x", lambda e: e["block"]), "\n\n").alias("context"), F.transform("x", lambda e: e["chunk"]).alias("chunks"))


def diagnostics() -> Column:
    """A ranked chunk as it is logged."""
    return F.struct("rank", "chunk_id", "vector_score", "rerank_score", "book_title", "chapter_title", "section_path", "chunk_index", T.preview(F.col("text")).alias("text_preview"))


def answer(
    questions: DataFrame, points: DataFrame, models: Models | None = None, k: int = 5, rerank: bool = True, spec: dict | None = None, threshold: float | None = None,
    most: int = 1500, chat: Chat | None = None, system_prompt: str | None = None, prompts_path: str | None = None, log_path: str | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """Rows ``query_id, question`` with ``answer, answer_found, chunks, requested_k, initial_k, rerank_enabled``, the reply's ``model`` and tokens, and ``extra``.

    The instruction is ``system_prompt``, or that of the file ``prompts_path``, or the models' own; an empty one is left out.
    Blank questions raise; a question without chunks gets the fixed answer and no model call. With ``log_path`` the answers are
    also logged under the day. With a ``ledger`` replies that it holds aren't asked for again.
    """
    models = models or Models()
    chat = chat or Chat(models.names.get("answer", "unknown"))
    if not questions.where(T.strip(F.coalesce("question", F.lit(""))) == "").isEmpty():
        raise ValueError("a question is blank")
    system = settings.system_prompt(prompts_path, models.system_prompt) if system_prompt is None else system_prompt
    blocks = context(retrieve(questions, points, models, k, rerank, spec, threshold), most)
    joined = questions.select("query_id", "question").join(blocks, "query_id", "left")
    some = F.col("context").isNotNull()
    talk = F.when(some, messages(T.user_prompt(F.col("question"), F.col("context")), system))
    if ledger is None:
        # behind a generator the reply is a column: the model is asked once, and only where there is a context
        asked = joined.select("*", F.explode(F.array(F.when(some, models.generate(talk, chat).cast(REPLY)))).alias("reply"))
    else:
        asked = ledger.replies(joined, "chat", talk, lambda said: models.generate(said, chat).cast(REPLY), asdict(chat))
    none = F.to_json(F.struct(F.lit("no_chunks").alias("reason")))
    extra = F.to_json(F.struct(F.lit(most).alias("max_chars_per_chunk"), F.lit(chat.temperature).cast("double").alias("temperature")), {"ignoreNullFields": "false"})
    text = F.when(some, F.col("reply.content")).otherwise(F.lit(T.NOTHING_FOUND_ANSWER))
    out = asked.select(
        "query_id", "question", text.alias("answer"), (some & T.answer_found(text)).alias("answer_found"), "chunks", F.lit(k).alias("requested_k"), F.lit(4 * k if rerank else k).alias("initial_k"), F.lit(rerank).alias("rerank_enabled"),
        F.coalesce("reply.model", F.lit(chat.model)).alias("model"), "reply.prompt_tokens", "reply.completion_tokens", "reply.total_tokens", F.when(some, extra).otherwise(none).alias("extra"),
    )
    if log_path is not None:
        writers.query_log(log_rows(out, models, spec), log_path)
    return out


def log_rows(answers: DataFrame, models: Models, spec: dict | None = None) -> DataFrame:
    """Answers as log rows: with the time in UTC, its date, model names and the filter as JSON."""
    import json

    now = F.current_timestamp()
    return answers.withColumn("timestamp_utc", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).withColumn("log_date", F.date_format(now, "yyyy-MM-dd")).withColumn("models", F.lit(json.dumps(models.names, sort_keys=True))).withColumn("filters", F.lit(None if spec is None else json.dumps(spec, ensure_ascii=False)))


def joined_scores(final: DataFrame, vector_scores: DataFrame, rerank_scores: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Final chunks with the scores of both stages; missing ones are null, of several the last by rank."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by("score", "rank").alias(name))
    return final.join(last(vector_scores, "vector_score"), key, "left").join(last(rerank_scores, "rerank_score"), key, "left")


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[Column], Column], most_texts: int = 512, most_tokens: int = 250_000, hard: int = 300_000, count: Callable[[Column], Column] = T.count_tokens) -> DataFrame:
    """Rows with ``vector``, by requests of bounded size: ``embed`` turns an array of texts into an array of vectors, a request a row.

    All rows are one queue in order of the key, cut into requests by ``batching.batches``; requests go to tasks whole. A reply with fewer
    vectors than texts raises. Keys must be unique.
    """
    queue = rows.select(F.lit(0).alias("queue"), F.col(key).alias("ord"), F.col(text).alias("piece")).withColumn("n_tokens", count(F.col("piece")))
    found = batching.batches(queue, "queue", "n_tokens", most_texts, most_tokens, hard).drop("queue")
    numbered = queue.join(found, "ord")
    requests = numbered.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("x"))
    replies = requests.select("x", F.explode(F.array(embed(F.transform("x", lambda e: e["piece"])))).alias("got"))
    short = F.raise_error(F.lit("the embedding model returned fewer vectors than texts"))
    whole = F.when(F.size("got") < F.size("x"), short.cast("int")).otherwise(0)
    vectors_of = replies.withColumn("ok", whole).where("ok = 0").select(F.explode(F.arrays_zip(F.transform("x", lambda e: e["ord"]).alias("key"), F.col("got").alias("vector"))).alias("z"))
    return rows.join(vectors_of.select(F.col("z.key").alias("__key"), F.col("z.vector").alias("vector")), F.col(key) == F.col("__key")).drop("__key")
