"""The average-cost ledger as a stream: each holding's state is read and written once per micro-batch.

The state of a key is its holding, cost, cash and realised result. Keys are dealt into lots by hash; the states of a lot
are one value in the engine's state store, so that a batch costs a call to the store and to Python per lot, not per key. A
batch brings new trades, which are folded in order from these states; nothing of earlier batches is read again. Trades of a
key must not arrive in a later batch than their successors; within a batch any order will do. The number of lots belongs to
the checkpoint and must stay the same when a query goes on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Stateful processors keep their state here.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("holding", "total_cost", "cash_balance", "realized_pnl")])


def fold(state: tuple[float, float, float, float], side: str, quantity: float, price: float, fee: float) -> tuple[float, float, float, float]:
    """One trade: a buy adds its debit to the cost; a sale is capped by the holding and releases its share of the cost."""
    holding, cost, cash, realized = state
    if side == "BUY":
        debit = quantity * price + fee
        return holding + quantity, cost + debit, cash - debit, realized
    sold = min(quantity, holding)
    if sold <= 0:
        return state
    released = cost if sold == holding else cost / holding * sold
    proceeds = sold * price - fee
    return holding - sold, cost - released if sold < holding else 0.0, cash + proceeds, realized + proceeds - released


LOT = T.StructType([T.StructField("states", T.BinaryType())])


class LedgerProcessor(StatefulProcessor):
    """Trades of the holdings of one lot -> the holding's state after each of them."""

    def __init__(self, by: Sequence[str], order: Sequence[str]) -> None:
        self.by, self.order = list(by), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", LOT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trades = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        held = self.state.get()
        states = {}
        if held is not None:
            columns = pa.ipc.open_stream(bytes(held[0])).read_all().to_pydict()
            names = zip(*(columns[f"key{i}"] for i in range(len(self.by))), strict=True)
            states = dict(zip(names, zip(*(columns[c] for c in STATE.names), strict=True), strict=True))
        keys = list(zip(*(trades[c].astype(object).where(trades[c].notna(), None) for c in self.by), strict=True))
        nothing, steps = (0.0,) * len(STATE), []
        for k, *trade in zip(keys, trades["side"], trades["quantity"], trades["price"], trades["fee"], strict=True):
            states[k] = fold(states.get(k, nothing), *trade)
            steps.append(states[k])
        table = pa.table([*(pa.array(c) for c in zip(*states, strict=True)), *(pa.array(c, pa.float64()) for c in zip(*states.values(), strict=True))], names=[*(f"key{i}" for i in range(len(self.by))), *STATE.names])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        yield pd.concat([trades[[*self.by, *self.order]], pd.DataFrame(steps, columns=STATE.names)], axis=1)

    def close(self) -> None:
        pass


@contextmanager
def state_provider(spark: SparkSession):
    """The state store that stateful processors need, for queries started inside."""
    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ledger_stream(trades: DataFrame, by: Sequence[str], order: Sequence[str], lots: int = 64) -> DataFrame:
    """by, order and the state after every trade. trades: by, order, side, quantity, price, fee."""
    fields = [trades.schema[c] for c in dict.fromkeys([*by, *order])]
    dealt = trades.withColumn("_lot", F.pmod(F.xxhash64(*by), F.lit(lots)))
    return dealt.groupBy("_lot").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(by, order), outputStructType=T.StructType([*fields, *STATE.fields]), outputMode="Append", timeMode="None"
    )


def run_ledger(trades: DataFrame, by: Sequence[str], order: Sequence[str], out: str, checkpoint: str, lots: int = 64) -> StreamingQuery:
    """Folds what is available now and stops; run again with the same checkpoint to go on."""
    with state_provider(trades.sparkSession):
        stream = ledger_stream(trades, by, order, lots).writeStream.outputMode("append").format("parquet")
        return stream.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
