"""Secret scans: three base patterns, and the guess cost of values that stand in a credential's place.

The cost of a value is the least product of the guesses for its parts over all ways to cut it into
dictionary words, dates, repeats, keyboard walks, sequences and brute-force spans, times the factorial of
the number of parts, found by dynamic programming over positions. A value that costs at least
10^``min_log10`` guesses is reported as kind ``guess``. The dictionary holds the most frequent words of
the corpus itself, counted over all documents, beside some frequent passwords.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import discard, materialize, small_batches

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth|api[_-]?key|private[_-]?key|access[_-]?key)["']?(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20(?:is|was)\x20(?:["'`]))["'`]?([^\s"'`,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: A text whose lower case holds none of these has no match of the pattern.
ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_CUES = ("pass", "pwd", "pin", "secret", "token", "credential", "auth", "key")
#: Frequent passwords and words in them, most frequent first; a word's rank is its guess cost.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football shadow "
    "superman michael charlie donald hello secret test user root guest default changeme example sample token access love baseball "
    "trustno1 batman starwars summer winter spring autumn freedom whatever computer internet server system manager company office "
    "house water money flower orange purple yellow silver golden the and for with that this from have will your our you not"
).split()
#: A dictionary word has this many letters.
WORD_LETTERS = (3, 24)
#: Rows of a US keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEIGHBOURS = {
    key: {KEY_ROWS[r + dr][c + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and 0 <= r + dr < len(KEY_ROWS) and 0 <= c + dc < len(KEY_ROWS[r + dr])}
    for r, row in enumerate(KEY_ROWS)
    for c, key in enumerate(row)
}
LEET = str.maketrans("4@310$5+7", "aaeiosstt")
#: Ways to write a date; a part may be what any of them matches.
DATES = (re.compile(r"(?:19|20)\d\d[-/.]?\d{1,2}[-/.]?\d{1,2}", re.ASCII), re.compile(r"\d{1,2}[-/.]?\d{1,2}[-/.]?(?:19|20)?\d\d", re.ASCII), re.compile(r"(?:19|20)\d\d", re.ASCII))


class Lexicon:
    """Words by rank (1 for the most frequent); a word's rank is its guess cost.

    words: further words, most frequent first, beside the frequent passwords.
    """

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.rank: dict[str, int] = {}
        for ranked in (WORDS, words):
            for i, w in enumerate(ranked, 1):
                self.rank[w] = min(i, self.rank.get(w, i))
        self.longest_word = max(map(len, self.rank))
        self.longest_part = max(self.longest_word, 10)

    def cost(self, value: str, low: str, plain: str) -> float | None:
        """log10 guesses of a part given as it stands, in lower case and with its digits and signs read as letters."""
        rank = self.rank.get(low)
        leet = self.rank.get(plain) if rank is None else None
        if not (rank or leet):
            return None
        return math.log10(rank or leet) + (0.0 if value == low else 0.6) + (0.0 if rank else 0.6)


PLAIN = Lexicon()


def date_ends(value: str, i: int) -> Iterator[tuple[int, float]]:
    for end in {m.end() for d in DATES if (m := d.match(value, i))}:
        yield end, 2.3 if end - i == 4 else 4.6


def block_ends(value: str, i: int, period_end: Callable[[int], int], word_costs: dict[int, float], room: float) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of a block of two or more characters at i and as many repeats of it as follow, for each block that repeats and costs less than room.

    The block costs its brute force, or its rank if it is a word (word_costs by end). period_end(n): where the
    run around i ends in which every character equals the one n places later.
    """
    total, last = brute_cost(value[i]), max(word_costs, default=0)
    for j in range(i + 2, (len(value) + i) // 2 + 1):
        total += brute_cost(value[j - 1])
        if total >= room and j > last:
            break
        if value[i] == value[j]:
            size = j - i
            times = (period_end(size) - i) // size
            if times > 1:
                yield i + times * size, min(total, word_costs.get(j, total)) + math.log10(times)


def run_ends(value: str) -> tuple[list[int], list[int], list[int]]:
    """For each position, where a repeat of one character, a keyboard walk and a sequence that begin there end."""
    n, low = len(value), value.lower()
    repeat, walk, sequence, step = list(range(1, n + 1)), list(range(1, n + 1)), list(range(1, n + 1)), [0] * n
    for i in range(n - 2, -1, -1):
        if value[i] == value[i + 1]:
            repeat[i] = repeat[i + 1]
        if low[i + 1] in NEIGHBOURS.get(low[i], ()):
            walk[i] = walk[i + 1]
        step[i] = ord(value[i + 1]) - ord(value[i])
        if step[i] in (1, -1):
            sequence[i] = sequence[i + 1] if i + 2 < n and step[i + 1] == step[i] else i + 2
    return repeat, walk, sequence


def span_costs(value: str, lexicon: Lexicon = PLAIN) -> list[list[tuple[int, float]]]:
    """For each start: (end, log10 guesses) of every part that is a word, date, repeat, walk or sequence."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    repeat, walk, sequence = run_ends(value)
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        words = {j: c for j in range(i + WORD_LETTERS[0], min(n, i + lexicon.longest_word) + 1) if (c := lexicon.cost(value[i:j], low[i:j], plain[i:j])) is not None}
        period_end = lambda size: next((k for k in range(i, n - size) if value[k] != value[k + size]), n - size) + size  # noqa: B023, E731
        spans[i] += [*words.items(), *date_ends(value, i), *block_ends(value, i, period_end, words, math.inf)]
        for ends, least, cost in ((repeat, 3, 1.0), (walk, 4, 1.7), (sequence, 3, 0.9)):
            for j in range(i + least, ends[i] + 1):
                spans[i].append((j, cost + math.log10(j - i) + (0.3 * (j - i) ** 0.5 if ends is walk else 0.0)))
    return spans


def brute_cost(character: str) -> float:
    """log10 of the size of the set that a guesser would draw this character from."""
    return 1.0 if character.isdigit() else math.log10(26) if character.isalpha() and character.isascii() else math.log10(33)


class Parts:
    """The parts that begin at each position, asked for in ascending order, without a pass over the whole value.

    A repeat or a sequence costs less than the brute force, the date or the second run that would follow it
    inside its own run of characters, so only ends near the run's end, or where a word, date or block may begin, count.
    """

    def __init__(self, value: str, lexicon: Lexicon):
        self.value, self.low, self.lexicon = value, value.lower(), lexicon
        self.plain = self.low.translate(LEET)
        self.ends = {"repeat": 0, "walk": 0, "sequence": 0}
        self.periods: dict[int, int] = {}
        self.step = 0

    def _run(self, kind: str, i: int, goes_on) -> int:
        """End of the run of characters around i whose neighbours satisfy goes_on(position of the first)."""
        if i >= self.ends[kind]:
            j = i + 1
            while j < len(self.value) and goes_on(j - 1):
                j += 1
            self.ends[kind] = j
        return self.ends[kind]

    def _period_end(self, i: int, size: int) -> int:
        """End of the run around i whose characters equal those size places later."""
        k = self.periods.get(size, 0) - size
        if k < i:
            k = i
            while k + size < len(self.value) and self.value[k] == self.value[k + size]:
                k += 1
            self.periods[size] = k + size
        return k + size

    def _sequence_end(self, i: int) -> int:
        value, n = self.value, len(self.value)
        if i + 1 >= self.ends["sequence"]:
            self.step = ord(value[i + 1]) - ord(value[i]) if i + 1 < n else 0
            j = i + 2
            while self.step in (1, -1) and j < n and ord(value[j]) - ord(value[j - 1]) == self.step:
                j += 1
            self.ends["sequence"] = j
        return self.ends["sequence"] if self.step in (1, -1) else i + 1

    def at(self, i: int, room: float) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of the parts that begin at i and cost less than room."""
        value, low, n = self.value, self.low, len(self.value)
        words = {}
        for j in range(i + WORD_LETTERS[0], min(n, i + self.lexicon.longest_word) + 1):
            cost = self.lexicon.cost(value[i:j], low[i:j], self.plain[i:j])
            if cost is not None:
                words[j] = cost
        yield from words.items()
        yield from date_ends(value, i)
        yield from block_ends(value, i, lambda size: self._period_end(i, size), words, room)
        end = self._run("repeat", i, lambda j: value[j] == value[j + 1])
        for j in range(max(i + 3, end - self.lexicon.longest_part), end + 1):
            yield j, 1.0 + math.log10(j - i)
        end = self._run("walk", i, lambda j: low[j + 1] in NEIGHBOURS.get(low[j], ()))
        for j in range(i + 4, end + 1):
            cost = 1.7 + math.log10(j - i) + 0.3 * (j - i) ** 0.5
            if cost >= room:
                break
            yield j, cost
        end = self._sequence_end(i)
        near = max(i + 3, end - self.lexicon.longest_part)
        early = [] if near == i + 3 or not (value[i].isascii() or value[end - 1].isascii() or value[i].isdecimal() or value[end - 1].isdecimal()) else range(i + 3, near)
        for j in (*early, *range(near, end + 1)):
            yield j, 0.9 + math.log10(j - i)


def guess_cost(value: str, enough: float = math.inf, lexicon: Lexicon = PLAIN) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs; ``enough`` if all need that many.

    Costs only grow along a segmentation, so one that has reached ``enough`` is left where it is; the search
    ends as soon as none is open, for most long values after a few characters.
    """
    n, parts = len(value), Parts(value, lexicon)
    times = [0.0]  # log10 of the factorial of the number of parts
    # open_[i]: (number of parts, is the last one brute force) -> least cost of value[:i]; two brute-force parts never touch.
    open_: dict[int, dict[tuple[int, bool], float]] = {0: {(0, False): 0.0}}
    far = 0
    for i in range(n):
        if i > far:
            break
        for (k, forced), cost in sorted(open_.pop(i, {}).items()):
            if len(times) < k + 2:
                times.append(math.lgamma(k + 2) / math.log(10))
            room = enough - times[k + 1] - cost
            following = [(j, c, False) for j, c in parts.at(i, room)]
            if not forced:
                total = 0.0
                for j in range(i, n):
                    total += brute_cost(value[j])
                    if total + cost + times[k + 1] >= enough:
                        break
                    following.append((j + 1, total, True))
            for j, c, brute in following:
                states = open_.setdefault(j, {})
                if cost + c + times[k + 1] < min(enough, states.get((k + 1, brute), math.inf) + times[k + 1]):
                    states[k + 1, brute] = cost + c
                    far = max(far, j)
    return min((cost + math.lgamma(k + 1) / math.log(10) for (k, _), cost in open_.get(n, {}).items()), default=enough)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    low, found = text.lower(), []
    if any(cue in low for cue in ASSIGN_CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, min_log10: float, lexicon: Lexicon = PLAIN) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(cue in low for cue in CONTEXT_CUES):
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], min_log10, lexicon) >= min_log10]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def frequent_words(docs: DataFrame, most: int = 20_000, least_count: int = 2) -> list[str]:
    """The most frequent words of all texts of docs, most frequent first, ties by code points: at most ``most``.

    Words are runs of 3 to 24 letters in lower case that occur at least least_count times. Values in a
    credential's place are not counted: a secret that many copies hold is no word for that. A histogram of
    the counts (16 classes an octave) fixes the count from which on there are at most ``most`` words; these
    alone reach the driver.
    """
    text = F.when(F.lower("text").rlike("|".join(CONTEXT_CUES)), F.regexp_replace("text", "(?i)" + CONTEXT.pattern, " ")).otherwise(F.col("text"))
    words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(*WORD_LETTERS))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    counted = materialize(counted.withColumn("octave", F.floor(16 * F.log2("n")).cast("int")), "words")
    least, total = None, 0
    for r in sorted(counted.groupBy("octave").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r.octave
    found = counted.where(F.col("octave") >= least).select("word", "n").collect() if least is not None else []
    discard(counted)
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))]


def scan_secrets(docs: DataFrame, min_log10: float = 10.0, words: list[str] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, n_guess, base, spans.

    base and spans list ``kind:start:end`` in code points, end exclusive, by start and then by kind; spans
    adds the values in a credential's place that cost at least 10^min_log10 guesses (whole runs of 6 or more
    characters). words: the dictionary, most frequent first (None: frequent_words of docs, at most 20,000, which
    are broadcast). A null text counts as empty; null and repeated ids pass through; other columns are
    ignored; an empty table gives no rows. Each text is scanned whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Lexicon(frequent_words(docs) if words is None else words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                guess = guess_spans(text, min_log10, shipped.value) if text else []
                row = [sum(k == kind for _, k, _ in base) for kind in range(3)] + [len(guess), written(base), written(sorted(base + guess))]
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            arrays = [pa.array(x, pa.int64()) for x in columns[:4]] + [pa.array(x, pa.string()) for x in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string")


def redacted(text: str, min_log10: float, mask: str, lexicon: Lexicon = PLAIN) -> str:
    """The text with each run of touching spans replaced by the mask."""
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + guess_spans(text, min_log10, lexicon)):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, min_log10: float = 10.0, mask: str = "[secret]", words: list[str] | None = None) -> DataFrame:
    """All rows and columns of docs; spans of scan_secrets are masked in text, and n_chars, where there is one, follows."""
    shipped = docs.sparkSession.sparkContext.broadcast(Lexicon(frequent_words(docs) if words is None else words))
    text = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = list(batch.columns)
            before = batch.column(text).to_pylist()
            after = [t and redacted(t, min_log10, mask, shipped.value) for t in before]
            columns[text] = pa.array(after, batch.schema.field(text).type)
            if counted is not None:
                sizes = [n if a == b else len(a) for a, b, n in zip(after, before, batch.column(counted).to_pylist(), strict=True)]
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
