"""Texts that were decoded with the wrong character encoding.

A smoothed character n-gram model of the clean records judges every place with characters beyond ASCII. Each chain of
encodings that could have made the place is undone: the characters are turned back into bytes by the encoding they
were read in, and those bytes are decoded by the one they were written in, once or repeatedly. The likeliest result is
accepted if its log likelihood exceeds that of the stored characters by a margin. The margin is set on all records, each
held out of the counts that judge it, as they are and garbled by all kinds of chains. What a place gains is at most what it
loses as it stands, so that places which lose less than the margin need no search.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.charmodel import EDGE, CharModel, codes, collected, counts, run_place, train
from strandweave.session import delete_at_end, partitions_for, scratch_path

#: Encodings that texts are wrongly read in, and encodings they are written in. A parameter each.
READ_IN = ("latin-1", "cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "iso8859-15", "iso8859-2")
WRITTEN_IN = ("cp1252", "cp1251", "cp1250", "cp1253", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "mac_cyrillic", "iso8859-5")
WRITTEN_WIDE = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
READ_WIDE = ("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
#: The longest chain of wrong readings that is undone.
DEPTH = 3
#: The parts of the texts. The margin is set on all of them, each judged by the counts of the others.
FOLDS = 10
#: The margin of a corpus with too few records beyond ASCII (``LEAST_EVIDENCE``) to set one: odds of a million to one.
PRIOR_MARGIN, LEAST_EVIDENCE = 13.8, 20
#: A record's gain need only be known up to this for the margin; it is doubled, and all are judged again, if the margin lay beyond.
ENOUGH = 60.0
#: The first model has seen the garbled records, too. Of each place it keeps what is likelier by ``SETTLED``, which is
#: what the next model is trained on, and so on for ROUNDS models.
ROUNDS = 2
SETTLED = 5.0
#: What a candidate that is more common as a whole than the stored form gains by that at most.
LIFT = 3.0
#: The part of a line beyond ASCII from which it may have been written in several bytes a character.
DENSE = 0.3
#: A run that occurs so often elsewhere, without a more common candidate, is as it was written: a stretch ends there.
COMMON = 30
#: The loss a character that a candidate may have, with the characters after it.
LIKELY = 3.0
NO_CANDIDATE = (-np.inf, 0.0, "")
LOST = "�"
#: Places that a worker remembers; it starts anew beyond them.
REMEMBERED = 200_000
#: The characters of the texts that are scored at once; a longer text is scored alone.
SCORED_CHARS = 300_000

#: The bytes of input, as the optimiser estimates them, to a file of the distinct texts.
TEXT_BYTES = 4 << 20

#: A place: characters beyond ASCII, with short stretches of blanks, digits and light punctuation between them.
_RUN = re.compile(r"[^\x00-\x7f]+")
_NEAR = re.compile(r"[ ,;:.()'\"0-9-]{1,6}")
_ZONE = re.compile(r"[^\x00-\x7f]+(?:[ ,;:()'\"0-9-]{1,4}[^\x00-\x7f]+)*")
_LINE = re.compile(r"[^\r\n]*[^\x00-\x7f][^\r\n]*")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _reader(encoding: str) -> dict[str, str]:
    """Character to byte (as the Latin-1 character of that number); bytes without a character stand for themselves."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            char = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            char = chr(byte)
        table.setdefault(char, chr(byte))
    return table


@lru_cache(maxsize=64)
def _writer(encoding: str) -> dict[str, str]:
    """Byte (as a Latin-1 character) to the character that it was written for."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[chr(byte)] = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            pass
    return table


def _decoded(match: re.Match) -> str:
    try:
        return match[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return match[0]


@dataclass
class Undoer:
    """All single steps back from a wrong reading."""

    read_in: tuple[str, ...] = READ_IN
    written_in: tuple[str, ...] = WRITTEN_IN
    written_wide: tuple[str, ...] = WRITTEN_WIDE
    read_wide: tuple[str, ...] = READ_WIDE

    def __post_init__(self) -> None:
        readers = {r: _reader(r) for r in self.read_in}
        # A character that a reader can't have made is mapped out of the range of bytes, so that none takes it for one.
        outside = {c: "\u0100" for c in range(0x80, 0x100)}
        self.to_bytes = [outside | {ord(c): b for c, b in back.items()} for back in readers.values()]
        self.chars = [frozenset(back) for back in readers.values()]
        of_bytes = lambda back, low, high: "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"
        self.pairs = [re.compile(of_bytes(b, "\xc2", "\xf4") + of_bytes(b, "\x80", "\xbf")) for b in readers.values()]
        writers = {w: _writer(w) for w in self.written_in}
        tables: dict[tuple, tuple[dict, frozenset, frozenset]] = {}
        for back in readers.values():
            for forth in writers.values():
                # Characters that both encodings agree on can't tell a wrong reading.
                moved = {ord(c): forth[b] for c, b in back.items() if forth.get(b, c) != c}
                kept = {c for c, b in back.items() if forth.get(b) == c}
                if moved:
                    touched = frozenset(map(chr, moved))
                    tables.setdefault(tuple(sorted(moved.items())), (moved, touched, touched | kept))
        self.tables = list(tables.values())

    def utf8_steps(self, place: str) -> set[str]:
        """The place with every UTF-8 sequence that a reader left in it decoded, by reader."""
        steps = set()
        for table, pair in zip(self.to_bytes, self.pairs):
            # Only a place with a first and a following byte is worth turning into bytes.
            if pair.search(place) and _UTF8.search(data := place.translate(table)):
                out, at = [], 0
                for m in _UTF8.finditer(data):
                    out += [place[at : m.start()], _decoded(m)]
                    at = m.end()
                steps.add("".join([*out, place[at:]]))
        # Read in several bytes a character, what was UTF-8 became characters of the far East.
        if max(place) >= "\u2e80":
            for r in self.read_wide:
                try:
                    steps.add(place.encode(r).decode("utf-8"))
                except UnicodeError:
                    continue
        return steps

    def byte_steps(self, place: str) -> set[str]:
        """The place with every character of a reader turned into what its byte was written for, by pair."""
        chars = {c for c in place if c > "\x7f"}
        return {place.translate(moved) for moved, touched, covered in self.tables if chars <= covered and not chars.isdisjoint(touched)}

    def wide_steps(self, line: str) -> set[str]:
        """The line in the encodings of several bytes a character, if all of it decodes."""
        steps = set()
        chars = {c for c in line if c > "\x7f"}
        for table, known in zip(self.to_bytes, self.chars):
            if not chars <= known:
                continue
            data = line.translate(table).encode("latin-1")
            for w in self.written_wide:
                try:
                    steps.add(data.decode(w))
                except UnicodeDecodeError:
                    continue
        return steps

    def candidates(self, place: str, depth: int) -> set[str]:
        """What a place may have been: UTF-8 undone up to ``depth`` times, before it single bytes once."""
        found, last = set(), {place}
        for step in range(depth):
            if step < 2:
                for p in last:
                    found |= self.byte_steps(p)
            last = {x for p in last for x in self.utf8_steps(p)} - found
            if not last:
                break
            found |= last
        return found - {place}


class Restorer:
    """Finds and undoes wrong readings in texts; remembers a bounded number of places."""

    def __init__(self, model: CharModel, margin: float, undoer: Undoer, depth: int = DEPTH) -> None:
        self.model, self.margin, self.undoer, self.depth = model, margin, undoer, depth
        self.known: dict[tuple[str, str, str, bool], tuple[float, float, str]] = {}

    def _known(self, candidate: str, place: str) -> bool:
        """Whether the characters that a candidate brings occur elsewhere, but for one in ten."""
        new = [c for c in candidate if c > "\x7f" and c not in place]
        return 10 * int((self.model.occurrences("".join(new)) < 2).sum()) <= len(new)

    def best(self, before: str, place: str, after: str, wide: bool = False) -> tuple[float, float, str]:
        """The likeliest candidate for a place between two characters a side: its score, how common it is as a whole, its text."""
        key = (before, place, after, wide)
        found = self.known.get(key)
        if found is None:
            options = sorted(self.undoer.wide_steps(place) - {place} if wide else self.undoer.candidates(place, self.depth))
            found = NO_CANDIDATE
            if options:
                scores = self.model.scores([before + c + after for c in options])
                # A candidate must be likely by itself, not only likelier than what is stored. The second character
                # after a place may be garbled, too, and is left out of this.
                near = after if after.isascii() else after[:1]
                alone = scores if near == after else self.model.scores([before + c + near for c in options])
                likely = alone > [-LIKELY * (len(c) + len(near)) for c in options]
                likely[likely] = [self._known(c, place) for c, yes in zip(options, likely.tolist()) if yes]
                if likely.any():
                    # Runs are compared as a whole, too, as the n-grams of a rare run predict each other too well.
                    times = np.array([self.model.runs[run_place(before[-1] + c + after[0])] for c in options])
                    at = int(np.argmax(np.where(likely, scores + np.log1p(times), -np.inf)))
                    found = (float(scores[at]), float(np.log1p(times[at])), options[at])
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return found

    def restore_all(self, texts: list[str], enough: float = np.inf) -> list[tuple[float, str]]:
        """Per text the largest gain of a place, and the text with all accepted places restored.

        A text of which a run gains ``enough`` is left as it is with that gain, and no other place of it is looked at.

        A text counts as one of those that the model was trained on; its own part in the counts is left out. In a text
        with an accepted place the others need less: a text that was read wrongly once was so elsewhere, too.
        """
        out: list[tuple[float, str]] = [(-np.inf, t) for t in texts]
        group, size = [], 0
        for i, text in enumerate(texts):
            if text.isascii():
                continue
            if group and size + len(text) > SCORED_CHARS:
                self._restore_group(texts, group, out, enough)
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            self._restore_group(texts, group, out, enough)
        return out

    def restore(self, text: str) -> tuple[float, str]:
        """``restore_all`` of one text."""
        return self.restore_all([text])[0]

    def _restore_group(self, texts: list[str], group: list[int], out: list[tuple[float, str]], enough: float) -> None:
        again = []
        for i, loss, runs in self._losses(texts, group, self.margin):
            gain, restored = self._restored(texts[i], loss, runs, self.margin, enough)
            out[i] = gain, restored
            if gain > self.margin > SETTLED:
                again.append((i, restored))
        # What is left in texts with an accepted place, by the lesser margin.
        others = {i: t for i, t in again}
        for i, loss, runs in self._losses(others, list(others), SETTLED):
            out[i] = out[i][0], self._restored(others[i], loss, runs, SETTLED)[1]

    def _losses(self, texts, group: list[int], margin: float) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]]]]:
        """(text, summed losses, runs) of the texts in which a place may gain more than the margin.

        All texts of the group are scored in one pass. Sum j is the loss of the characters before j, the two edges
        after the text included.
        """
        if not group:
            return
        padded = [EDGE + EDGE + texts[i] + EDGE + EDGE for i in group]
        # Two edges before the first text, too, as every other one has the edges after the text before it.
        points, lengths = codes("".join([EDGE + EDGE, *padded])), np.array([len(p) for p in padded])
        owner = np.concatenate([[-1, -1], np.repeat(np.arange(len(group)), lengths)])
        lost = -self.model.log_probs(points, owner)
        starts = np.cumsum(lengths) - lengths + 2
        sums = np.concatenate([[0.0, 0.0, 0.0], np.cumsum(lost)])
        change = np.flatnonzero(np.diff((points > 0x7F).astype(np.int8)))
        begin, end = change[::2] + 1, change[1::2] + 1
        loses = sums[end + 2] - sums[begin]
        # A dense line may lose little in each of its runs.
        telling = (loses >= margin - LIFT) | (end - begin >= 4)
        of = owner[begin]
        for k in np.unique(of[telling]):
            own = of == k
            first, n = int(starts[k]) + 2, int(lengths[k]) - 4
            yield group[k], sums[first : first + n + 3] - sums[first], list(zip((begin[own] - first).tolist(), (end[own] - first).tolist()))

    def _restored(self, text: str, loss: np.ndarray, runs: list[tuple[int, int]], margin: float, enough: float = np.inf) -> tuple[float, str]:
        padded, ended = EDGE + EDGE + text, text + EDGE + EDGE

        def tried(start: int, end: int, wide: bool = False) -> tuple[float, float, str]:
            """The gain of a place's best candidate, how much more common as a whole it is than what is stored, its text."""
            score, often, candidate = self.best(padded[start : start + 2], text[start:end], ended[end : end + 2], wide)
            framed = padded[start + 1] + text[start:end] + ended[end]
            stored = max(0, int(self.model.runs[run_place(framed)]) - framing.count(framed))
            more = float(often - np.log1p(stored))
            # A place's own characters and the two after it are all that a candidate can make likelier.
            return score + loss[end + 2] - loss[start] + min(LIFT, more), more, candidate

        framing = EDGE + text + EDGE
        # No run gains more than its loss and ``LIFT``; those that may gain most come first.
        able = [(float(loss[e + 2] - loss[s]), (s, e)) for s, e in runs if loss[e + 2] - loss[s] + LIFT >= enough]
        for _, r in sorted(able, reverse=True):
            if (gain := tried(*r)[0]) >= enough:
                return gain, text
        found = {r: tried(*r) for r in runs if loss[r[1] + 2] - loss[r[0]] >= margin - LIFT}
        gains = {r: (g, c) for r, (g, _, c) in found.items()}
        longer = []

        def try_long(s: int, e: int, wide: bool) -> None:
            if loss[e + 2] - loss[s] >= margin - LIFT:
                gain, _, c = tried(s, e, wide)
                inner = [g for (a, b), (g, _) in gains.items() if s <= a and b <= e and g > margin]
                if gain > max(margin, sum(inner)):
                    longer.append((s, e, gain, c))

        for m in _LINE.finditer(text):
            s, e = m.span()
            inside = [r for r in runs if s <= r[0] and r[1] <= e]
            if sum(b - a for a, b in inside) >= DENSE * (e - s):
                try_long(s, e, True)
            if len(inside) > 1 and any(found[r][1] > 1 or found[r][0] > margin for r in inside if r in found):
                for stretch in self._stretches(text, inside, found, tried):
                    try_long(*stretch, False)
        single = [(*r, g, c) for r, (g, c) in gains.items() if g > margin]
        largest = max([-np.inf, *(g for g, _ in gains.values()), *(g for _, _, g, _ in longer)])
        out, at = [], 0
        # Longer places were only kept where they gain more than what lies within them.
        for s, e, _, c in sorted([*longer, *single], key=lambda x: (x[0], -x[1])):
            if s >= at:
                out += [text[at:s], c]
                at = e
        return float(largest), "".join([*out, text[at:]])


    def _stretches(self, text: str, runs: list[tuple[int, int]], found: dict, tried) -> list[tuple[int, int]]:
        """Stretches of several neighbouring runs that may have been read wrongly as a whole.

        They begin and end with runs that have a more common candidate, may hold others in between that say nothing,
        and never reach over a run that is common as it is.
        """
        out, current, last = [], None, None
        for r in runs:
            gain, more, candidate = found[r] if r in found else tried(*r)
            if current is not None and not _NEAR.fullmatch(text[last:r[0]]):
                current = None
            last = r[1]
            if more > 1 and gain > -np.inf:
                if current is None:
                    current = [r[0], r[1], 1]
                    out.append(current)
                else:
                    current[1], current[2] = r[1], current[2] + 1
            elif more < -np.log1p(COMMON):
                current = None
        return [(s, e) for s, e, n in out if n > 1]


def garble(text: str, chain: list[tuple[str, str]]) -> str:
    """The text written in and read in each pair of encodings; characters that can't be written stay."""
    for written, read in chain:
        back = {}
        for c in set(text):
            if c > "\x7f":
                try:
                    data = c.encode(written)
                except UnicodeEncodeError:
                    continue
                table = _writer(read)
                back[ord(c)] = "".join(table.get(chr(b), chr(b)) for b in data)
        text = text.translate(back)
    return text


def all_chains(undoer: Undoer) -> list[list[tuple[str, str]]]:
    """Chains of wrong readings of every kind: UTF-8 read as single bytes, once and twice, single bytes as others, wide ones."""
    once = [[("utf-8", r)] for r in undoer.read_in]
    swapped = [[(w, r)] for w, r in zip(undoer.written_in, (*undoer.read_in[1:], undoer.read_in[0])) if w != r]
    return [*once, [("utf-8", "cp1252")] * 2, *swapped, *[[(w, "latin-1")] for w in undoer.written_wide]]


def garbled_forms(text: str, number: int, chains: list[list[tuple[str, str]]]) -> tuple[int, str] | None:
    """The number of a chain that changes the text, the first from ``number`` on, and the text, in one place or, every second time, as a whole."""
    zones = [m.span() for m in _ZONE.finditer(text)]
    s, e = zones[number % len(zones)] if zones and number % 2 else (0, len(text))
    for k in range(len(chains)):
        chain = (number // 2 + k) % len(chains)
        try:
            wrong = garble(text[s:e], chains[chain])
        except LookupError:
            continue
        if wrong != text[s:e]:
            return chain, text[:s] + wrong + text[e:]
    return None


def gap_margin(stored: np.ndarray, top: float) -> float:
    """The margin in the widest gap, in proportion, between successive gains of stored records from ``SETTLED`` up to ``top``: its middle, in proportion."""
    ends = np.array([SETTLED, *np.sort(stored), top])
    k = int(np.argmax(ends[1:] / ends[:-1]))
    return float(np.sqrt(ends[k] * ends[k + 1]))


def set_margin(stored: list[float], garbled: list[float]) -> float:
    """The margin from the gains of held-out records as they are stored and of the same records garbled.

    Most stored records are clean, a few are garbled: their gains lie in two groups. The margin lies in the widest gap,
    in proportion, between successive gains of stored records, from ``SETTLED`` up to the gain that all but one in fifty
    of the garbled records reach: in its middle, in proportion.
    """
    reached = sorted(g for g in garbled if g > SETTLED)
    if len(reached) < LEAST_EVIDENCE:
        return PRIOR_MARGIN
    top = reached[len(reached) // 50]
    return gap_margin(np.array([g for g in stored if SETTLED < g < top]), top)


def margin_of(gains: DataFrame, enough: float = np.inf) -> float | None:
    """``set_margin`` of a table (kind, gain), None if gains from ``enough`` on, which are known no further, could change it.

    Only the stored records' gains between the two ends come to the driver.
    """
    reached = gains.where((F.col("kind") >= 0) & (F.col("gain") > SETTLED)).select("gain")
    n = reached.count()
    if n < LEAST_EVIDENCE:
        return PRIOR_MARGIN
    top = reached.orderBy("gain").limit(n // 50 + 1).agg(F.max("gain").alias("top")).first().top
    if top >= enough:
        return None
    stored = gains.where((F.col("kind") < 0) & (F.col("gain") > SETTLED) & (F.col("gain") < top)).select("gain").toArrow()
    return gap_margin(stored.column(0).to_numpy(), top)


def held_out_gains(texts: DataFrame, model, undoer: Undoer, enough: float) -> DataFrame:
    """(kind, gain) of the records (hash, text), gains from ``enough`` on being known no further: kind -1 as they are, else the number of the chain that they were garbled by.

    The records weren't counted by the model, whose own parts are left out nevertheless, as they are of records judged.
    """
    chains = all_chains(undoer)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value, SETTLED, undoer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            wrong = [f for h, t in zip(batch.column(0).to_pylist(), texts) if (f := garbled_forms(t, h & 0xFFFF, chains))]
            kinds = [-1] * len(texts) + [k for k, _ in wrong]
            gains = [g for g, _ in restorer.restore_all([*texts, *(t for _, t in wrong)], enough)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(gains, pa.float64())], names=["kind", "gain"])

    return texts.select("hash", "text").mapInArrow(judge, "kind int, gain double")


@dataclass
class Fitted:
    """A model of clean text, its margin, and the held-out gains (kind, gain) that it was set by."""

    model: CharModel
    margin: float
    gains: DataFrame


def fit(texts: DataFrame, column: str, undoer: Undoer | None = None) -> Fitted:
    """The model of clean text and the validated margin, both of all distinct texts.

    The distinct texts are written once to the shared folder: copies of a text would make its garbled places likely.
    The first model is one of all texts. As wrong readings are the exception, it finds what was written likelier than
    what was read; the next model is trained on the texts with such places restored, which takes the garbled forms out
    of the counts without leaving out any record. Its counts are kept by fold, of which each text belongs to one, by its
    hash. All records beyond ASCII are held out once: the model without the counts of a fold judges the fold's records.
    (The first model, which only settles how the other texts are counted, has seen them.)
    """
    undoer = undoer or Undoer()
    spark, context = texts.sparkSession, texts.sparkSession.sparkContext
    known = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text"))

    def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
        path = scratch_path(spark, label)
        delete_at_end(spark, path)
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    whole = known.repartition(partitions_for(known, TEXT_BYTES), "text").distinct().withColumn("hash", F.xxhash64("text"))
    fold, beyond = F.pmod("hash", F.lit(FOLDS)).cast("int"), F.col("text").rlike("[^\\x00-\\x7f]")
    plain = stored(whole.select("hash", "text", beyond.alias("beyond"), fold.alias("fold")), "texts", "fold")
    change = spread = None
    for _ in range(ROUNDS - 1):
        spread = context.broadcast(train(plain, "text", change))
        change = _settled(spread, undoer)
    folds = stored(counts(plain, "text", change, "fold"), "counts", "fold")
    if spread:
        spread.unpersist()
    model = collected(folds.groupBy("level", "place").agg(F.sum("n").alias("n")))
    held = [context.broadcast(model.without(collected(folds.where(F.col("fold") == k)))) for k in range(FOLDS)]
    margin, enough = None, ENOUGH / 2
    while margin is None:
        enough *= 2
        judged = [held_out_gains(plain.where(F.col("beyond") & (F.col("fold") == k)), m, undoer, enough) for k, m in enumerate(held)]
        gains = stored(reduce(DataFrame.unionAll, judged), "gains")
        margin = margin_of(gains, enough)
    for m in held:
        m.unpersist()
    return Fitted(model, margin, gains)


def _settled(model, undoer: Undoer) -> Callable[[list[str]], list[str]]:
    judges: list[Restorer] = []

    def settle(texts: list[str]) -> list[str]:
        if not judges:
            judges.append(Restorer(model.value, SETTLED, undoer))
        return [t for _, t in judges[0].restore_all(texts)]

    return settle


def find_garbled(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, gain, restored, lost) of the rows whose text holds wrongly read characters.

    ``restored`` is the text with every accepted place undone, ``gain`` the largest gain in log likelihood of a place,
    ``lost`` whether characters are lost (U+FFFD), which nothing brings back. Null, empty and ASCII texts are never
    garbled. Repeated rows are judged alike. Whole texts are read, and the model is one of all distinct clean texts. Further
    columns are not read. An empty table gives no rows.
    """
    undoer = Undoer()
    fitted = fit(rows, text, undoer)
    spread, margin = rows.sparkSession.sparkContext.broadcast(fitted.model), fitted.margin

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(spread.value, margin, undoer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [(i, g, restored, LOST in t) for i, (t, (g, restored)) in enumerate(zip(texts, restorer.restore_all(texts)))]
            found = [f for f in found if f[1] > margin or f[3]]
            columns = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.float64()), (2, pa.string()), (3, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *columns], names=["doc_id", "gain", "restored", "lost"])

    beyond = rows.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = beyond.mapInArrow(judge, f"doc_id {dict(beyond.dtypes)['doc_id']}, gain double, restored string, lost boolean")
    return out.withColumnRenamed("doc_id", doc_id)
