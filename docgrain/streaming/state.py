"""What a stream has to remember from batch to batch, as state of the query: the registry of names, the journal of texts.

State is kept by Structured Streaming, in its checkpoint: a restart goes on with what the last finished batch knew, and
a batch that is repeated begins from the same state as before. Rows of a batch are taken in the order of ``seq``, so
that several batches give what one would that holds their rows in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docgrain.functions import text as T
from docgrain.operators.resolution import THRESHOLD, Forms

#: Keys that documents are dealt to; each keeps the hashes of its documents.
PLACES = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Registry(StatefulProcessor):
    """The canonical forms of a type and block, a list; the form that each earlier one has joined, a map."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "form string")
        self.joined = handle.getMapState("joined", "form string", "canonical string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        forms = Forms(self.threshold)
        for (form,) in self.known.get():
            forms.add(form)
        before = len(forms.order)
        frame = pd.concat(rows).sort_values(["seq", "form"], kind="stable")
        found: dict[str, str] = {}
        for form in frame["form"].drop_duplicates():
            seen = self.joined.getValue((form,)) if form not in forms.order else None
            found[form] = seen[0] if seen else forms.place(form)
            if not seen and found[form] != form:
                self.joined.updateValue((form,), (found[form],))
        added = list(forms.order)[before:]
        if added:
            self.known.appendList([(form,) for form in added])
        yield pd.DataFrame({"name": frame["name"].array, "type": key[0], "canonical": frame["form"].map(found).array})

    def close(self) -> None:
        pass


def resolve_stream(names: DataFrame, threshold: float = THRESHOLD, aliases: dict[str, str] | None = None) -> DataFrame:
    """(name, type, canonical) of every row of a stream of (name, type, seq), against all names that came before.

    The rule is that of :func:`docgrain.operators.resolution.resolve`, with the registry as state of each type and
    block (first two characters of the form). Names with an empty form, or without a type, are left out.
    """
    rows = names.withColumn("form", T.entity_name(F.col("name"), aliases)).where("form <> '' and type is not null")
    keyed = rows.select("name", "form", "seq", "type", F.substring("form", 1, 2).alias("block")).groupBy("type", "block")
    return keyed.transformWithStateInPandas(_Registry(threshold), "name string, type string, canonical string", "Append", "None")


class _Journal(StatefulProcessor):
    """Hashes of the texts of the documents dealt to a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "id string", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["seq", "hash"], kind="stable")
        status = []
        for name, hash in zip(frame["id"], frame["hash"], strict=True):
            old = self.done.getValue((name,))
            status.append("new" if old is None else "unchanged" if old[0] == hash else "updated")
            if status[-1] != "unchanged":
                self.done.updateValue((name,), (hash,))
        yield frame[["id", "seq", "text"]].assign(status=status)

    def close(self) -> None:
        pass


def journal_stream(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", seq_col: str = "seq", places: int = PLACES) -> DataFrame:
    """(id, seq, text, status) of every row of a stream: new, updated or unchanged since its id came last.

    What has status unchanged need not be enriched again; after a restart that holds for all of earlier runs too. A
    null text is empty; rows without an id are left out. ``places`` is fixed for the life of a checkpoint.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(seq_col).cast("long").alias("seq"), text.alias("text"), F.md5(text).alias("hash"))
    keyed = rows.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(places)).cast("int")).groupBy("place")
    return keyed.transformWithStateInPandas(_Journal(), "id string, seq long, text string, status string", "Append", "None")


def run(stream: DataFrame, sink: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write all that has arrived to Parquet at ``sink``, a folder for each batch, and end; a repeated batch overwrites itself."""
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enriched(batch: DataFrame, extract: Callable[[DataFrame], DataFrame], wanted: Column | None = None) -> DataFrame:
    """What ``extract`` finds in the rows of a journal's batch that need it: the new and updated ones that are ``wanted``."""
    need = batch.where("status <> 'unchanged'")
    return extract((need if wanted is None else need.where(wanted)).select(F.col("id").alias("chunk_id"), "text"))
