"""Streams of lines with a state for each: secrets over a line's end, and ids and a hint for the whole stream.

Lines are redacted by themselves first, map-only and natively. The keyed step then sees a line and the next one of its stream
together: a surface match over the end between them, within TAIL characters on either side, goes from both. So a line is given
out once the next one has come, or its stream has ended or been silent for a while; what's kept in between is that line and the
ids so far. What's given out doesn't depend on how the stream was cut into batches, nor on restarts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import itemgetter
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark.catalog import Rule
from veilspark.engine import Engine, placeholder
from veilspark.functions.text import hint
from veilspark.operators.redact import redact

#: Characters on either side of a line's end that are looked at together.
TAIL = 256
#: Buckets that streams are dealt to. A query that goes on from a checkpoint must keep its number.
BUCKETS = 4096
GIVEN = Row("stream", "seq", "redacted", "rules", "ids")


class Held(NamedTuple):
    """A stream's newest line, the ids so far, and when the stream has been silent for too long (milliseconds)."""

    stream: object
    seq: int
    line: str
    redacted: str
    rules: list[str]
    cut: int
    ids: list[str]
    due: int | None


def over_the_end(engine: Engine, line: str, after: str) -> tuple[int, int, str, str] | None:
    """The leftmost match over the end of a line: how many characters of the line go, and of the one after, the placeholder and the rule's id."""
    tail, head = line[-TAIL:], after[:TAIL]
    spans = [(a, b, f) for a, b, f in engine.matches(tail + head) if a < len(tail) < b]
    if not spans:
        return None
    a, b, f = min(spans, key=lambda x: x[0])
    return len(tail) - a, b - len(tail), placeholder(f), f.rule_id


class LineStream(StatefulProcessor):
    """Rows: stream, seq, line, redacted, rules, last, by buckets of streams. Gives out stream, seq, redacted, rules, ids (of the whole stream, with its last line only).

    A call costs some milliseconds, whatever it's given; so it's for a bucket of streams, each of which has its own line, ids and time.
    """

    def __init__(self, rules: Sequence[Rule], silent_ms: int | None, kind: str):
        self.rules, self.silent_ms, self.kind = tuple(rules), silent_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.engine = handle, Engine(self.rules)
        self.held = handle.getValueState("held", f"held array<struct<stream {self.kind}, seq long, line string, redacted string, rules array<string>, cut int, ids array<string>, due long>>")

    def _done(self, now: Held, cut: int, mark: str, ids: list[str]) -> tuple[str, list[str]]:
        """A line with what goes from its front and its end, and its ids."""
        text, rules = now.redacted, now.rules
        if cut or mark or now.cut:
            text, rules = self.engine.redact(now.line[now.cut : max(now.cut, len(now.line) - cut)])
            text += mark
        return text, list(dict.fromkeys([*rules, *ids])) if ids else rules

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a bucket's share of one batch, which the source's limits bound; rows of a batch come in any order
        came = sorted(((r.stream, r.seq, r.line, r.redacted, r.rules, r.last) for r in rows), key=itemgetter(1))
        due = None if self.silent_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
        held = self._load()
        out: list[Row] = []
        for stream, seq, line, redacted, rules, last in came:
            now, cut, ids = held.get(stream), 0, []
            if now is not None:
                span = over_the_end(self.engine, now.line[now.cut :], line)
                text, found = self._done(now, span[0], span[2], [span[3]]) if span else self._done(now, 0, "", [])
                cut = span[1] if span else 0
                ids = list(dict.fromkeys([*now.ids, *found])) if found else now.ids
                out.append(GIVEN(stream, now.seq, text, found, None))
            new = Held(stream, seq, line, redacted, rules, cut, ids, due)
            if last:
                out.append(self._closed(new))
                held.pop(stream, None)
            else:
                held[stream] = new
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self._keep(held)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._load(), timerValues.getCurrentProcessingTimeInMs()
        silent = [h for h in held.values() if h.due is not None and h.due <= now]
        for h in silent:
            del held[h.stream]
        self._keep(held)
        yield from map(self._closed, silent)

    def _load(self) -> dict[object, Held]:
        """The lines that are held, by stream."""
        return {h.stream: h for h in (Held(*x) for x in self.held.get()[0])} if self.held.exists() else {}

    def _keep(self, held: dict[object, Held]) -> None:
        if held:
            self.held.update(([tuple(h) for h in held.values()],))
        else:
            self.held.clear()
        if self.silent_ms is not None and held:  # one timer, for the stream that's due first
            self.handle.registerTimer(min(h.due for h in held.values()))

    def _closed(self, now: Held) -> Row:
        text, rules = self._done(now, 0, "", [])
        return GIVEN(now.stream, now.seq, text, rules, list(dict.fromkeys([*now.ids, *rules])))

    def close(self) -> None:
        pass


def redact_streams(stream: DataFrame, rules: Sequence[Rule], tool: str = "veilspark", silent_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """stream, seq, redacted, rules, ids and hint of lines; ids and hint are with a stream's last line only.

    stream: a streaming table of stream (a number or text, say: Python must be able to hash it), seq (ascending from batch to batch), line (null counts as empty) and last (whether the
    line ends its stream; null counts as not). With silent_ms, a stream that's silent for so long ends as well, and begins anew
    with its next line; the query must then run on a trigger with an interval, since one that takes what's available waits for
    timers without end. Command output is untrusted: markers don't count. Needs the RocksDB state store. A batch reads and writes
    the state of each bucket that it has lines for; what a bucket holds of one batch, and of streams that haven't ended, must fit a
    task's memory.
    """
    plain = stream.select("stream", F.col("seq").cast("long").alias("seq"), F.coalesce("line", F.lit("")).alias("line"), F.coalesce("last", F.lit(False)).alias("last"))
    done = redact(plain, "line", rules).select(F.pmod(F.hash("stream"), F.lit(buckets)).alias("bucket"), "stream", "seq", "line", "redacted", "rules", "last")
    kind = stream.schema["stream"].dataType.simpleString()
    found = done.groupBy("bucket").transformWithState(
        statefulProcessor=LineStream(rules, silent_ms, kind), outputStructType=f"stream {kind}, seq long, redacted string, rules array<string>, ids array<string>", outputMode="Append", timeMode="None" if silent_ms is None else "ProcessingTime"
    )
    return found.withColumn("hint", hint(tool, F.col("ids")))
