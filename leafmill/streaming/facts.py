"""Facts folded from a stream: each waits until nothing earlier can come, then meets the fact that is known.

The state of a (key, field) is the fact that won so far and the facts that still wait.  A fact is folded when the
watermark passes its time, in order of time and ``ord``, whatever order micro-batches bring them in; so the rows are
those of :func:`leafmill.operators.resolve.fold_facts` over the same facts.  Facts that come later than the watermark
allows are dropped by the stream.  The state of one key is bounded by the facts that wait, those of one watermark delay.

The session needs the RocksDB provider for state stores (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.functions.facts import REASONS, Fact, Known, fold
from leafmill.session import ship_code

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FACT = "ord long, at long, value string, confidence double, page long, source string"
_KNOWN = "value string, confidence double, page long, source string, by_confidence long, by_source long, by_page long, by_default long"


class _Folder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._known = handle.getValueState("known", _KNOWN)
        self._waiting = handle.getListState("waiting", _FACT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            facts = [Fact(*r) for r in frame[["ord", "at", "value", "confidence", "page", "source"]].itertuples(index=False)]
            facts = [f._replace(ord=int(f.ord), at=int(f.at), confidence=float(f.confidence), page=int(f.page)) for f in facts]
            self._waiting.appendList([tuple(f) for f in facts])
            times |= {f.at for f in facts}
        for at in times:
            self._handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [Fact(*x) for x in self._waiting.get()] if self._waiting.exists() else []
        ripe = sorted((f for f in waiting if f.at <= until), key=lambda f: (f.at, f.ord))
        left = [tuple(f) for f in waiting if f.at > until]
        if left:
            self._waiting.put(left)
        elif waiting:
            self._waiting.clear()
        known = Known(*self._known.get()) if self._known.exists() else None
        out = []
        for f in ripe:
            known, why = fold(known, f)
            out.append((*key, f.ord, why, f.value, known.value, known.confidence, known.page, *known[4:]))
        if ripe:
            self._known.update(tuple(known))
        columns = ["key", "field", "ord", "outcome", "told", "value", "confidence", "page", *REASONS]
        return iter([pd.DataFrame(out, columns=columns)] if out else ())

    def close(self) -> None:
        pass


def folded_facts(facts: DataFrame, at: str = "at", late: str = "1 hour") -> DataFrame:
    """An audit row for every fact of a stream (key, field, ord, value, confidence, page, source and a time), once it counts.

    ``outcome`` is first, same or the rule that settled a conflict, ``told`` the fact's own value; value, confidence, page
    and the four counts are what is known of (key, field) from then on.
    """
    ship_code(facts.sparkSession)
    kinds = facts.schema
    timed = facts.withWatermark(at, late)
    slim = timed.select(
        "key", "field", "ord", F.unix_millis(F.col(at)).alias("at"), "value", F.col("confidence").cast("double").alias("confidence"),
        F.col("page").cast("long").alias("page"), "source", F.col(at).alias("event_time"),
    )
    shape = (
        f"key {kinds['key'].dataType.simpleString()}, field {kinds['field'].dataType.simpleString()}, ord long, outcome string, told string, "
        "value string, confidence double, page long, " + ", ".join(f"{c} long" for c in REASONS)
    )
    return slim.groupBy("key", "field").transformWithStateInPandas(
        statefulProcessor=_Folder(), outputStructType=shape, outputMode="Append", timeMode="EventTime"
    )
