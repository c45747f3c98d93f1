"""Keyed state for the tape: bars of two sizes with late trades beside them, and rules to alerts and incidents.

Both processors run per symbol under Spark's event-time watermark, which is one for all symbols: the largest event time so
far less the allowed lateness. The watermark is put on a time that runs AHEAD of the event's own, with the delay longer by as
much. So its value is the tape's own watermark, and no late row is dropped before a processor has seen it (rows more than
AHEAD behind are). Spark keeps watermarks in milliseconds; steps are whole milliseconds, so bars close as in the
batch form. State is a value a bar (not the trades), alert or incident, kept in the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days that a row may be behind the watermark and still be seen.
AHEAD = 3650
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_BAR = "open_id long, open long, high long, low long, close_id long, close long, volume long, quote decimal(38,0), sell long, trades long"
_UP = "open_us long, open long, high long, low long, close_us long, close long, volume long, quote decimal(38,0), sell long, trades long, bars long"
TAPE_OUT = (
    "kind string, symbol string, bar_us long, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(24,8), quote_volume decimal(28,8), sell_volume decimal(24,8), "
    "trade_count long, active_bars long, vwap decimal(18,8), agg_trade_id long, quantity decimal(18,8), event_us long, arrival_us long, watermark_us long"
)
_WIDE = Context(prec=60)


def watermarked(rows: DataFrame, time_us: str, lateness_s: float) -> DataFrame:
    """rows with mark_time, on which the watermark is that of time_us."""
    marked = rows.withColumn("mark_time", F.timestamp_micros(F.col(time_us)) + F.expr(f"INTERVAL {AHEAD} DAYS"))
    return marked.withWatermark("mark_time", f"{AHEAD * 86_400_000 + round(lateness_s * 1000)} milliseconds")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(schema: str):
    """A maker of output rows: what is not named is null."""
    make, blank = Row(*names(schema)), dict.fromkeys(names(schema))
    return lambda **values: make(*(blank | values).values())


def _price(units: int) -> Decimal:
    return Decimal(units).scaleb(-8, _WIDE)


class Bars(StatefulProcessor):
    """Trades to bars of step_us, closed by the watermark and rolled up to bars of up_us.

    A trade whose bar ended at or before the watermark that its batch met comes out as kind "late" with that watermark.
    Larger bars before first_up_us, that of the tape's earliest trade in its first batch, are never given out. Rows
    marked as closing move the watermark and are no trades; after a symbol's last bars comes a row of kind "closing" with
    the last step of the tape.
    """

    def __init__(self, step_us: int, up_us: int, first_up_us: int, lateness_us: int):
        self.step, self.up, self.first_up, self.lateness = step_us, up_us, first_up_us, lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, _rows(TAPE_OUT)
        self.bars = handle.getMapState("bars", "bar_us long", _BAR)
        self.larger = handle.getMapState("larger", "bar_us long", _UP)
        self.end = handle.getValueState("end", "mark_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh: dict[int, list] = {}
        for r in rows:
            if r.closing:  # its time is the last trade's plus the lateness and a larger bar
                self.end.update((r.event_us - self.lateness,))
                self.handle.registerTimer((r.event_us - self.lateness) // 1000)
                continue
            bar = r.event_us - r.event_us % self.step
            if bar + self.step <= mark:
                yield self.out(kind="late", symbol=key[0], bar_us=bar, agg_trade_id=r.agg_trade_id, quantity=_price(r.units), event_us=r.event_us, arrival_us=r.arrival_us, watermark_us=mark)
                continue
            x, sell = (r.agg_trade_id, r.ticks, r.ticks, r.ticks, r.agg_trade_id, r.ticks, r.units, r.ticks * r.units, r.units if r.is_buyer_maker else 0, 1), fresh.get(bar)
            fresh[bar] = list(x) if sell is None else self._joined(sell, x)
        for bar, x in fresh.items():
            if self.bars.containsKey((bar,)):
                old = self.bars.getValue((bar,))
                x = self._joined([*old[:7], int(old[7]), *old[8:]], x)
            else:
                # both at once: a timer that is set while others fire waits for the next batch
                self.handle.registerTimer((bar + self.step) // 1000)
                self.handle.registerTimer((bar - bar % self.up + self.up) // 1000)
            self.bars.updateValue((bar,), (*x[:7], Decimal(x[7]), *x[8:]))

    @staticmethod
    def _joined(a: list, b) -> list:
        """Two parts of a bar; first and last go by the trade's number."""
        first, last = (a if a[0] <= b[0] else b), (a if a[4] >= b[4] else b)
        return [first[0], first[1], max(a[2], b[2]), min(a[3], b[3]), last[4], last[5], a[6] + b[6], a[7] + b[7], a[8] + b[8], a[9] + b[9]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        bar, up = end - self.step, end - self.up
        if self.bars.containsKey((bar,)):
            x = self.bars.getValue((bar,))
            self.bars.removeKey((bar,))
            yield self._bar("bar", key, bar, x, x[9])
            self._roll(bar, x)
        if end % self.up == 0 and self.larger.containsKey((up,)):
            x = self.larger.getValue((up,))
            self.larger.removeKey((up,))
            yield self._bar("larger", key, up, x, x[9], x[10])
        if self.end.exists() and (mark := self.end.get()[0]) // 1000 == end // 1000:
            last = mark - self.up
            yield self.out(kind="closing", symbol=key[0], bar_us=last - last % self.step)

    def _roll(self, bar: int, x) -> None:
        up = bar - bar % self.up
        if up < self.first_up:
            return
        if self.larger.containsKey((up,)):
            a = self.larger.getValue((up,))
            early, late = bar < a[0], bar > a[4]
            y = (min(a[0], bar), x[1] if early else a[1], max(a[2], x[2]), min(a[3], x[3]), max(a[4], bar), x[5] if late else a[5], a[6] + x[6], a[7] + x[7], a[8] + x[8], a[9] + x[9], a[10] + 1)
        else:
            y = (bar, x[1], x[2], x[3], bar, *x[5:10], 1)
        self.larger.updateValue((up,), y)

    def _bar(self, kind: str, key, bar: int, x, trades: int, active: int | None = None) -> Row:
        quote = Decimal((int(x[7]) + 50_000_000) // 100_000_000).scaleb(-8, _WIDE)
        return self.out(
            kind=kind, symbol=key[0], bar_us=bar, open=_price(x[1]), high=_price(x[2]), low=_price(x[3]), close=_price(x[5]), volume=_price(x[6]), quote_volume=quote, sell_volume=_price(x[8]), trade_count=trades, active_bars=active
        )

    def close(self) -> None:
        pass


def stream_tape(trades: DataFrame, lateness_s: float, step_us: int, up_us: int, first_up_us: int) -> DataFrame:
    """A stream of trades (symbol, agg_trade_id, price, quantity, is_buyer_maker, event_us, arrival_us, closing) as bars, larger
    bars, late trades and the symbol's end, told apart by kind. Needs STATE_STORE in the session."""
    units = lambda c: (F.col(c) * 100_000_000).cast("long")
    rows = trades.select("symbol", "agg_trade_id", units("price").alias("ticks"), units("quantity").alias("units"), "is_buyer_maker", "event_us", "arrival_us", F.coalesce("closing", F.lit(False)).alias("closing"))
    out = watermarked(rows, "event_us", lateness_s).groupBy("symbol").transformWithState(Bars(step_us, up_us, first_up_us, round(lateness_s * 1e6)), TAPE_OUT, "append", "eventtime")
    return out.withColumn("vwap", F.when(F.col("kind") == "larger", F.try_divide(F.col("quote_volume").cast("double"), F.col("volume").cast("double"))).cast("decimal(18,8)"))


RULES_OUT = (
    "kind string, symbol string, rule string, severity string, place int, opens boolean, fired_us long, cleared_us long, incident_us long, "
    "opened_us long, last_active_us long, detected_us long, opening_alerts long, resolved_us long, status string"
)


class Incidents(StatefulProcessor):
    """True conditions to alerts and incidents, in order of time whatever the order of arrival.

    A condition waits until the watermark has passed its step. Every change gives a row: an alert when it fires, joins an
    incident or clears; an incident when it opens and when it resolves. The last row of a key (alerts: symbol, rule,
    fired_us; incidents: symbol, opened_us) is its state. A closing row ends the tape at its t_us: what is
    still open then is given out once more as it stands.
    """

    def __init__(self, tick_us: int, quiet_us: int, lookback_us: int):
        self.tick, self.quiet, self.lookback = tick_us, quiet_us, lookback_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, _rows(RULES_OUT)
        self.waiting = handle.getMapState("waiting", "t_us long, place int", "rule string, clear_us long, opens boolean, severity string, known_us long")
        self.active = handle.getMapState("active", "rule string", "place int, fired_us long, last_us long, clear_us long, opens boolean, severity string, known_us long, incident_us long")
        self.alone = handle.getMapState("alone", "fired_us long, place int", "rule string, severity string, opens boolean, known_us long, cleared_us long")
        self.incident = handle.getValueState("incident", "opened_us long, until_us long, alerts long, known_us long")
        self.end = handle.getValueState("end", "end_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if r.closing:
                self.end.update((r.t_us,))
            else:
                self.waiting.updateValue((r.t_us, r.place), (r.rule, r.clear_us, r.opens, r.severity, r.known_us))
            self.handle.registerTimer(r.t_us // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        t = expiredTimerInfo.getExpiryTimeInMs() * 1000
        end = self.end.get()[0] if self.end.exists() else None
        if end is not None and t > end:
            return
        due = sorted(k for k in self._keys(self.waiting) if k[0] <= t)
        for k in due:
            yield from self._true(key[0], k[0], k[1], *self.waiting.getValue(k))
            self.waiting.removeKey(k)
        for (rule,) in sorted(self._keys(self.active)):
            a = self.active.getValue((rule,))
            if a[2] + a[3] <= t:
                self.active.removeKey((rule,))
                yield self._alert(key[0], rule, a, a[2] + a[3])
                if a[7] is None and self.alone.containsKey((a[1], a[0])):
                    self.alone.updateValue((a[1], a[0]), (*self.alone.getValue((a[1], a[0]))[:4], a[2] + a[3]))
        for k in [k for k in self._keys(self.alone) if k[0] + self.lookback < t]:
            self.alone.removeKey(k)
        if self.incident.exists():
            i = self.incident.get()
            if i[1] + self.quiet <= t:
                self.incident.clear()
                yield self._incident(key[0], i, i[1], i[1] + self.quiet, "resolved")
            elif t == end:
                yield self._incident(key[0], i, min(i[1], end), None, "open")

    @staticmethod
    def _keys(state) -> list[tuple]:
        return [tuple(k) for k in state.keys()]

    def _true(self, symbol: str, t: int, place: int, rule: str, clear: int, opens: bool, severity: str, known: int | None) -> Iterator[Row]:
        a = self.active.getValue((rule,)) if self.active.containsKey((rule,)) else None
        if a is not None and t - a[2] > a[3]:
            yield self._alert(symbol, rule, a, a[2] + a[3])
            a = None
        fires = a is None
        i = self.incident.get() if self.incident.exists() else None
        if i is not None and t > i[1] + self.quiet:
            yield self._incident(symbol, i, i[1], i[1] + self.quiet, "resolved")
            self.incident.clear()
            i = None
        if opens:
            if i is None:
                i = (t, t + clear - self.tick, 0, known)
                yield self._incident(symbol, (*i[:2], 1, known), i[1], None, "open")
                for fired, p in sorted(k for k in self._keys(self.alone) if k[0] >= t - self.lookback):
                    x = self.alone.getValue((fired, p))
                    self.alone.removeKey((fired, p))
                    if self.active.containsKey((x[0],)) and (b := self.active.getValue((x[0],)))[1] == fired:
                        self.active.updateValue((x[0],), (*b[:7], t))
                    yield self.out(kind="alert", symbol=symbol, rule=x[0], severity=x[1], place=p, opens=x[2], fired_us=fired, detected_us=x[3], cleared_us=x[4], incident_us=t)
            i = (i[0], max(i[1], t + clear - self.tick), i[2] + fires, i[3])
            self.incident.update(i)
            self.handle.registerTimer((i[1] + self.quiet) // 1000)
        if fires:
            a = (place, t, t, clear, opens, severity, known, None if i is None else i[0])
            yield self._alert(symbol, rule, a, None)
            if i is None:
                self.alone.updateValue((t, place), (rule, severity, opens, known, None))
        self.active.updateValue((rule,), (*a[:2], t, *a[3:]))
        self.handle.registerTimer((t + clear) // 1000)

    def _alert(self, symbol: str, rule: str, a, cleared: int | None) -> Row:
        return self.out(kind="alert", symbol=symbol, rule=rule, severity=a[5], place=a[0], opens=a[4], fired_us=a[1], detected_us=a[6], cleared_us=cleared, incident_us=a[7])

    def _incident(self, symbol: str, i, last: int, resolved: int | None, status: str) -> Row:
        return self.out(kind="incident", symbol=symbol, opened_us=i[0], last_active_us=last, detected_us=i[3], opening_alerts=i[2], resolved_us=resolved, status=status)

    def close(self) -> None:
        pass


def stream_incidents(conditions: DataFrame, tick_us: int, resolve_after_s: int, lookback_s: int, lateness_s: float = 0.0) -> DataFrame:
    """A stream of true conditions (symbol, t_us, rule, place, clear_us, opens, severity, known_us, closing) as changes of alerts and
    incidents. Needs STATE_STORE in the session."""
    rows = conditions.select("symbol", "t_us", "rule", "place", "clear_us", "opens", "severity", "known_us", F.coalesce("closing", F.lit(False)).alias("closing"))
    # a closing row moves the watermark beyond its own step, so that the step itself is done
    rows = rows.withColumn("moves_us", F.col("t_us") + F.when(F.col("closing"), round(lateness_s * 1e6) + 1000).otherwise(0))
    processor = Incidents(tick_us, resolve_after_s * 1_000_000, lookback_s * 1_000_000)
    return watermarked(rows, "moves_us", lateness_s).groupBy("symbol").transformWithState(processor, RULES_OUT, "append", "eventtime")
