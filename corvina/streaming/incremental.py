"""Preprocessing that goes on where it stopped: a page is preprocessed once for each text and each way to preprocess it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corvina.functions.text import Lemmas, preprocess
from corvina.sources.sinks import append_terms, filled, made_by, not_cached, with_key


def preprocess_batch(pages: DataFrame, store: str, components: Iterable[str], stop_words: Iterable[str] = (), lemmas: Callable[[], Lemmas] | None = None, text: str = "text", watch: Observation | None = None) -> DataFrame:
    """doc_id, title, terms of all the pages (doc_id, title, text); what the store lacks is preprocessed and appended to it first.

    The store knows a page by its title, its text and the way to preprocess it: a page that has moved in its dump is found, one that has changed isn't, and
    neither is any after a change of the components, the stop words or the lemmas.
    """
    components, stop_words = list(components), list(stop_words)
    keyed = with_key(pages.select("doc_id", "title", text), made_by(components, stop_words, lemmas), text=text)
    new = not_cached(keyed, store).dropDuplicates(["key"])
    append_terms(preprocess(new, components, stop_words, lemmas, text=text, watch=watch), store)
    return filled(keyed.select("doc_id", "title", "key"), store).select("doc_id", "title", "terms")


def preprocess_stream(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, components: Iterable[str], stop_words: Iterable[str] = ()) -> StreamingQuery:
    """Take up each Parquet file that arrives in ``folder`` once; a batch that is run again after a failure adds nothing twice."""
    components, stop_words = list(components), list(stop_words)

    def step(batch: DataFrame, _: int) -> None:
        preprocess_batch(batch, store, components, stop_words)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
