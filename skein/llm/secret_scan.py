"""Secret scans by grammar inference over labelled credentials.

Base patterns find assignments, access keys and long hex strings in whole texts. Their values are the labelled
credentials: a bounded sample of distinct values of each kind (over all documents, the smallest by hash: at most
``sample``, and no more once ``sample_chars`` characters are reached) is turned into a prefix tree over character
classes. States are merged in red-blue order, those of most strings first, if the frequencies of their next symbols,
of their ends and of the lengths still to come agree by the Hoeffding bound, and merges are folded into the subtrees;
of several such states the likeliest is taken. So a format of fixed length or with a fixed prefix keeps both. That
gives one probabilistic automaton a kind.

Candidates are all runs of ``LEAST`` or more token characters (the fewest a base value may have), and what base spans
leave of a run. Each is scored by the best automaton: log-likelihood a character, less that under a class-bigram model
of all such runs of all documents. Those above the threshold (the highest score of all ordinary runs plus a margin) are
spans of kind ``format``. Ordinary are runs of words: letters in one case or capitalised, between signs. So a
credential that looks like words isn't told from them by its format in the table that the model was learned on.

Null texts count as empty and have no spans; repeated rows keep a row each; other columns aren't read by ``scan`` and
pass through ``redact``; an empty table, or one without credentials, gives base results only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 8
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Classes of a run of words.
_WORDS = re.compile(r"(?:[FU]?[fl]+|[FU]+)(?:[+/_=-]+(?:[FU]?[fl]+|[FU]+))*[+/_=-]*")
#: A text without any of these words has no assignment.
_KEYS = re.compile(r"pass|secret|token|api", re.I | re.A)

Span = tuple[int, int, int, int, int]  # start, kind, end, start and end of the value


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start and kind."""
    out: list[Span] = []
    if _KEYS.search(text):
        out += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def symbols(value: str) -> str:
    """The value's characters as classes: digit 9, a-f f, other lower l, A-F F, other upper U, the rest as they are."""
    return value.translate(_CLASS)


_CLASS = {ord(c): k for cs, k in (("0123456789", "9"), ("abcdef", "f"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "F"), ("GHIJKLMNOPQRSTUVWXYZ", "U")) for c in cs}


class Automaton:
    """A probabilistic automaton learned by merging compatible states of a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.to: list[dict[str, int]] = []
        self.seen: list[Counter] = []  # how often each symbol follows
        self.left: list[Counter] = []  # how many strings have so many symbols to come; 0: end here
        self.n: list[int] = []
        self._state()
        for s in sorted(strings):
            state = 0
            for i, c in enumerate(s):
                self.n[state] += 1
                self.seen[state][c] += 1
                self.left[state][len(s) - i] += 1
                if c not in self.to[state]:
                    self.to[state][c] = self._state()
                state = self.to[state][c]
            self.n[state] += 1
            self.left[state][0] += 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.scores = self._log_probabilities()

    def _state(self) -> int:
        self.to.append({})
        self.seen.append(Counter())
        self.left.append(Counter())
        self.n.append(0)
        return len(self.n) - 1

    def _agree(self, p: int, q: int) -> bool:
        n, m = self.n[p], self.n[q]
        most = self.slack * (n**-0.5 + m**-0.5)
        if any(abs(self.seen[p][c] / n - self.seen[q][c] / m) > most for c in {*self.seen[p], *self.seen[q]}):
            return False
        gap = 0.0
        for k in sorted({*self.left[p], *self.left[q]}):
            gap += self.left[p][k] / n - self.left[q][k] / m
            if abs(gap) > most:
                return False
        return True

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if not self._agree(p, q):
                return False
            todo += [(self.to[p][c], t) for c, t in self.to[q].items() if c in self.to[p]]
        return True

    def _likelihood(self, p: int, q: int) -> float:
        """Of the next symbols and lengths to come at q, under those at p."""
        n = self.n[p] + 1.0
        of = lambda known, new: sum(k * math.log((known[x] + 0.01) / n) for x, k in new.items())
        return of(self.seen[p], self.seen[q]) + of(self.left[p], self.left[q])

    def _fold(self, p: int, q: int) -> None:
        """Add the subtree at q into p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.n[p] += self.n[q]
            self.seen[p].update(self.seen[q])
            self.left[p].update(self.left[q])
            for c, t in self.to[q].items():
                if c in self.to[p]:
                    todo.append((self.to[p][c], t))
                else:
                    self.to[p][c] = t

    def _merge_all(self) -> None:
        red, known = [0], {0}
        while True:
            blue = [(p, c, self.to[p][c]) for p in red for c in sorted(self.to[p]) if self.to[p][c] not in known]
            if not blue:
                break
            p, c, q = max(blue, key=lambda x: (self.n[x[2]], -x[2]))
            like = sorted((r for r in red if self._agree(r, q)), key=lambda r: -self._likelihood(r, q))
            same = next((r for r in like if self._compatible(r, q)), None)
            if same is None:
                red.append(q)
                known.add(q)
            else:
                self.to[p][c] = same
                self._fold(same, q)
        self.red = red

    def _log_probabilities(self) -> dict[int, tuple[dict[str, tuple[int, float]], float]]:
        out = {}
        for p in self.red:
            n = self.n[p] + 1.0
            out[p] = ({c: (t, math.log((self.seen[p][c] + 0.5) / n)) for c, t in self.to[p].items()}, math.log((self.left[p][0] + 0.05) / n))
        return out

    def score(self, s: str, floor: float = -7.0) -> float:
        """Log-likelihood; a character without a transition costs ``floor`` and leaves the state."""
        state, total = 0, 0.0
        for c in s:
            step = self.scores[state][0].get(c)
            if step is None:
                total += floor
            else:
                state, total = step[0], total + step[1]
        return total + self.scores[state][1]


class Background:
    """Class bigrams of runs, from their counts."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pairs, self.ones = Counter(pairs), Counter()
        for (a, _), n in pairs.items():
            self.ones[a] += n

    def score(self, s: str) -> float:
        return sum(math.log((self.pairs[a, b] + 0.5) / (self.ones[a] + 16)) for a, b in zip("^" + s, s + "$"))


class SecretModel:
    def __init__(self, labelled: dict[str, list[str]], pairs: dict[tuple[str, str], int], margin: float = 0.25):
        self.automata = [Automaton([symbols(v) for v in sorted(vs)]) for _, vs in sorted(labelled.items())]
        self.known: dict[str, float] = {}
        self.background = Background(pairs)
        self.threshold = margin

    def raise_threshold(self, score: float) -> None:
        """Put the threshold above the score of an ordinary run."""
        self.threshold += max(0.0, score)

    def score(self, value: str) -> float:
        """Log-likelihood ratio a character."""
        return self.score_symbols(symbols(value)) if self.automata else -math.inf

    def score_symbols(self, s: str) -> float:
        out = self.known.get(s)
        if out is None:
            out = (max(a.score(s) for a in self.automata) - self.background.score(s)) / (len(s) + 1)
            if len(self.known) > 20_000:
                self.known.clear()
            if len(s) <= 64:
                self.known[s] = out
        return out

    def spans(self, text: str) -> list[Span]:
        out = base_spans(text)
        taken = [(s[0], s[2]) for s in out]
        if self.automata:
            for a, b in other_runs(text, taken):
                if self.score(text[a:b]) > self.threshold:
                    out.append((a, 3, b, a, b))
        return sorted(out)


def other_runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters, without the parts in spans of ``taken`` (which are in order of their starts)."""
    out, i, end = [], 0, 0
    for m in _RUN.finditer(text):
        at, stop = m.span()
        # Spans up to i start before this run; the furthest of them ends at ``end``.
        while i < len(taken) and taken[i][0] < stop:
            a, b = taken[i]
            if max(at, end) < a:
                out.append((max(at, end), a))
            end = max(end, b)
            i += 1
        if max(at, end) < stop:
            out.append((max(at, end), stop))
    return out


def learn(docs: DataFrame, sample: int = 400, sample_chars: int = 100_000) -> SecretModel:
    """Model from at most ``sample`` distinct values of each base kind, the smallest by hash (none after that which
    reaches ``sample_chars``), and all other runs."""

    def first(values: dict[int, str]) -> dict[int, str]:
        out, chars = {}, 0
        for key in sorted(values)[:sample]:
            if chars >= sample_chars:
                break
            out[key], chars = values[key], chars + len(values[key])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, dict[int, str]] = defaultdict(dict)
        chars: Counter[str] = Counter()
        others: Counter[str] = Counter()

        def offer(kind: str, value: str) -> None:
            key = int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=7).digest(), "big")
            if key not in best[kind]:
                best[kind][key] = value
                chars[kind] += len(value)
            if len(best[kind]) >= 2 * sample + 64 or chars[kind] >= 4 * sample_chars:
                best[kind] = first(best[kind])
                chars[kind] = sum(map(len, best[kind].values()))

        def told() -> Iterator[pd.DataFrame]:
            if others:
                yield pd.DataFrame([("", 0, v, n) for v, n in others.items()], columns=["kind", "h", "value", "n"])
                others.clear()

        for frame in slices(frames):
            for text in frame.text:
                if not isinstance(text, str):
                    continue
                spans = base_spans(text)
                for s in spans:
                    offer(KINDS[s[1]], text[s[3] : s[4]])
                others.update(symbols(text[a:b]) for a, b in other_runs(text, [(s[0], s[2]) for s in spans]))
            if len(others) > 20_000:
                yield from told()
        yield from told()
        if best:
            yield pd.DataFrame([(k, h, v, 1) for k, vs in best.items() for h, v in first(vs).items()], columns=["kind", "h", "value", "n"])

    def bigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter[tuple[str, str]] = Counter()
        for frame in frames:
            for s, n in zip(frame.value, frame.n):
                for pair in zip("^" + s, s + "$"):
                    pairs[pair] += n
        if pairs:
            yield pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["a", "b", "n"])

    def highest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [model.score_symbols(s) for s in frame.value if _WORDS.fullmatch(s)]
            if scores:
                yield pd.DataFrame({"score": [max(scores)]})

    got = docs.select("text").mapInPandas(run, "kind string, h long, value string, n long")
    got = cut(got.groupBy("kind", "h", "value").agg(F.sum("n").alias("n")))
    # The smallest of each part of a kind first, so that no task gets all tasks' values of it.
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h", "value"))
    labelled = got.where("kind <> ''").withColumn("part", F.pmod(F.xxhash64("h", "value"), F.lit(64)))
    labelled = labelled.withColumn("nth", nth("kind", "part")).where(F.col("nth") <= sample)
    labelled = labelled.withColumn("nth", nth("kind")).where(F.col("nth") <= sample)
    before = F.sum(F.length("value")).over(Window.partitionBy("kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    labelled = labelled.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_chars)
    values: dict[str, list[str]] = defaultdict(list)
    for r in labelled.select("kind", "value").collect():
        values[r["kind"]].append(r["value"])
    others = got.where("kind = ''").select("value", "n")
    # Classes and signs are few, so the sums are too.
    sums = others.mapInPandas(bigrams, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    model = SecretModel(dict(values), {(r["a"], r["b"]): r["n"] for r in sums})
    if model.automata:
        model.raise_threshold(others.mapInPandas(highest, "score double").agg(F.max("score")).first()[0] or 0.0)
    return model


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of (doc_id, text)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = model.spans(text) if isinstance(text, str) else []
            base = [s for s in spans if s[1] < 3]
            n = Counter(s[1] for s in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = F.pandas_udf(run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select("doc_id", found(F.col("text")).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]", chars: str | None = None) -> DataFrame:
    """docs with the value of each span in text replaced by ``mark``; texts without spans stay as they are, and so does
    the column ``chars``, which is set to the number of characters of texts that changed."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if isinstance(text, str):
                at, parts = 0, []
                for a, b in sorted({(s[3], s[4]) for s in model.spans(text)}):
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text if isinstance(text, str) else None)
        return pd.Series(out, dtype=object)

    new = F.pandas_udf(run, "string")(F.col("text"))
    count = {} if chars is None else {chars: F.when(new.eqNullSafe(F.col("text")), F.col(chars)).otherwise(F.length(new).cast("long"))}
    return docs.withColumns({"text": new, **count})


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, learn(docs))
