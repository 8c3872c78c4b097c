"""State that goes when it expires: keys of a stream with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key string, seq long, value string, expire_at long"


def expired(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(key, seq, value, expire_at) of keys as they expire, in append mode.

    The stream has (seq, key, op, value, ts timestamp, expire_at long). One value a key is held: the
    newest by seq. A newer write takes its place and timer; a deletion drops the timer and leaves its
    seq, so that late rows don't come back to life. When the
    watermark passes ``expire_at`` (ms) the key comes out and its state goes. A write without expiry
    stays until it is deleted.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    # a class of this function, so that workers get it by value
    class Expiry(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("latest", "seq long, op string, value string, expire_at long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            held = self.state.get() if self.state.exists() else None
            last = held
            for part in rows:
                row = part.loc[part["seq"].idxmax()]
                if last is None or int(row["seq"]) > last[0]:
                    at = row["expire_at"]
                    last = (int(row["seq"]), row["op"], row["value"], None if pd.isna(at) else int(at))
            if last is not held:
                if held is not None and held[3] is not None and held[1] != "DEL":
                    self.handle.deleteTimer(held[3])
                self.state.update(last)
                if last[1] != "DEL" and last[3] is not None:
                    self.handle.registerTimer(last[3])
            yield pd.DataFrame({"key": pd.Series(dtype=str), "seq": pd.Series(dtype="int64"), "value": pd.Series(dtype=str), "expire_at": pd.Series(dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            seq, _, value, at = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "seq": [seq], "value": [value], "expire_at": [at]})

        def close(self) -> None:
            pass

    rows = log.withWatermark("ts", late).select("seq", "key", "op", "value", "ts", "expire_at")
    return rows.groupBy("key").transformWithStateInPandas(Expiry(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
