"""Calls of a model as a step over tables: the model is an injected function, its replies can be kept and looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docnav.sources.keyed import KeyedTable

#: A model call: (kind, prompt) to reply. It runs on the executors, so it must be picklable; clients belong inside.
ModelFn = Callable[[str, str], str]


def stub_model(kind: str, prompt: str) -> str:
    """A deterministic stand-in: plans search for the question itself, verdicts support any evidence, answers quote it."""
    return {"plan": prompt, "verdict": "supported" if prompt else "insufficient"}.get(kind, f"answer to '{prompt}'")


def call_model(rows: DataFrame, kind: str, prompt: str, out: str, model: ModelFn = stub_model, error: str | None = None) -> DataFrame:
    """``rows`` with the model's reply to the column ``prompt`` in the column ``out``; rows without a prompt get none and cost no call. With ``error``, a
    call that fails gives a null reply and its message in that column; without, it fails the task, which is tried again.

    Only a number and the prompt go to Python; the rest of a row stays in the JVM's batch as it is.
    """
    names = [c for c in (out, error) if c]
    fields = [f for f in rows.schema.fields if f.name not in names]
    schema = StructType([*fields, *(StructField(n, StringType()) for n in names)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            replies, errors = [], []
            for p in batch.column(batch.schema.get_field_index(prompt)):
                reply = failed = None
                if p.is_valid:
                    try:
                        reply = model(kind, p.as_py())
                    except Exception as e:  # noqa: BLE001  kept as a row if asked for
                        if error is None:
                            raise
                        failed = f"{type(e).__name__}: {e}"[:400]
                replies.append(reply)
                errors.append(failed)
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            new = [pa.array(replies, pa.string())] + ([pa.array(errors, pa.string())] if error else [])
            yield pa.RecordBatch.from_arrays([*kept, *new], [*(f.name for f in fields), *names])

    return rows.mapInArrow(run, schema)


def cache_key(*columns: str) -> Column:
    """SHA-256 of the JSON of the named fields in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def cached_calls(prompts: DataFrame, cache: DataFrame, model: ModelFn = stub_model) -> DataFrame:
    """(key, prompt, reply, from_cache): replies from the cache by the digest of the prompt, the rest from the model, each once."""
    keyed = prompts.select("kind", "prompt").distinct().withColumn("key", cache_key("kind", "prompt"))
    hits = keyed.join(cache.select("key", "reply"), "key").withColumn("from_cache", F.lit(True))
    misses = keyed.join(cache, "key", "left_anti")
    fresh = call_model(misses, "answer", "prompt", "reply", model).withColumn("from_cache", F.lit(False))
    return hits.select("key", "prompt", "reply", "from_cache").union(fresh.select("key", "prompt", "reply", "from_cache"))


class ReplyCache:
    """Replies kept in a keyed table at ``path``: a prompt that was answered in an earlier batch is never sent again, and only files that may hold it are read."""

    SCHEMA = "key string, kind string, prompt string, reply string"

    def __init__(self, path: str):
        self.path = path

    def store(self, spark) -> KeyedTable:
        return KeyedTable(spark, self.path, self.SCHEMA)

    def table(self, spark) -> DataFrame:
        return self.store(spark).table()

    def answer(self, prompts: DataFrame, model: ModelFn = stub_model) -> DataFrame:
        """(key, prompt, reply, from_cache) for ``prompts(kind, prompt)``; fresh replies are stored before anything reads them, so each costs one call."""
        from docnav.operators.lineage import cut

        store = self.store(prompts.sparkSession)
        keyed = cut(prompts.select("kind", "prompt").distinct().withColumn("key", cache_key("kind", "prompt")))
        old = cut(store.lookup(keyed).select("key", "prompt", "reply"))
        misses = keyed.join(old.select("key"), "key", "left_anti")
        kinds = [r["kind"] for r in misses.select("kind").distinct().collect()]
        for kind in kinds:
            store.append(call_model(misses.where(F.col("kind") == kind), kind, "prompt", "reply", model).select("key", "kind", "prompt", "reply"))
        known = old.select("key", F.lit(True).alias("from_cache"))
        found = store.lookup(keyed).select("key", "prompt", "reply")
        return found.join(known, "key", "left").select("key", "prompt", "reply", F.coalesce("from_cache", F.lit(False)).alias("from_cache"))
