"""Secret scans: fixed base patterns, and formats learnt by grammar inference.

The base finds three kinds of spans by pattern. Beyond them, probabilistic automata are inferred from labelled
credentials: their prefix tree is built, and states whose continuations don't differ by more than a Hoeffding
bound are merged (ALERGIA), which leaves a small automaton with transition frequencies. Transitions are made by classes
of characters, so that states count lengths and separators; each state also keeps how often it gave each character, so that
prefixes and alphabets count. One automaton is inferred for each labelled format, one for ordinary tokens. Every maximal
run of token characters, of any length, is a candidate and is scored by all automata; it is a secret of kind ``format``
where a format's log-likelihood exceeds the ordinary one by ``MARGIN``. A symbol that a format's automaton has never seen
where it stands leaves the format: that symbol and all after it get the floor. The ordinary automaton begins anew there instead.
The labelled sets are generated from the published shapes of credentials with a fixed seed, so training needs no corpus and
no real secret; formats unlike any of them are found by the base only.

Distinct candidates of a batch are scored together, character by character, on stacked tables of the automata. Once no
format's automaton can go on and the ordinary one leads, the rest of a candidate can't change the verdict, and it is left.

Spans are code points with exclusive ends. Candidates that overlap a base span are dropped; base spans always stay.

Defined cases: a null or empty text has no span; spans are ordered by start, then by kind as listed in KINDS;
repeated rows are scanned one by one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.shared import map_batches, text_parts

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Token characters; points stand inside a candidate only, equals signs at its end only.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_.=-"
#: Natural-log likelihood by which a format must lead.
MARGIN = 12.0
FLOOR = 1e-4

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail the length it asks for."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


#: Classes of formats: letters, digits and signs of base 64 count alike; of ordinary tokens: kinds of letters apart.
LENGTHS = {c: "w" if c.isalnum() or c in "+/=" else c for c in ALPHABET}
KIND_OF = {c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in ALPHABET}


class Automaton:
    """A deterministic probabilistic automaton inferred from words, whose transitions are made by classes of symbols.

    next[q][c] is the state after class c; seen[q][c] how often; gave[q][s] how often the symbol was s; ends[q] how
    often a word ended there. Without classes each symbol is its own. With restart a symbol that was never seen is
    followed by the first state, else by none.
    """

    def __init__(self, words: list[tuple[str, ...]], classes: dict[str, str] | None = None, restart: bool = False, alpha: float = 0.05):
        self.classes, self.restart = classes or {}, restart
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.gave: list[dict[str, int]] = [{}]
        self.ends = [0]
        for w in words:
            q = 0
            for s in w:
                c = self.classes.get(s, s)
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.gave.append({})
                    self.ends.append(0)
                self.seen[q][c] = self.seen[q].get(c, 0) + 1
                self.gave[q][s] = self.gave[q].get(s, 0) + 1
                q = self.next[q][c]
            self.ends[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        size: dict[str, int] = {}
        for c in self.classes.values():
            size[c] = size.get(c, 0) + 1
        self.size = size

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    def _alike(self, p: int, q: int) -> bool:
        """Whether two states and all that follows them agree within the bound."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > limit:
                return False
            for s in self.seen[p].keys() | self.seen[q].keys():
                if abs(self.seen[p].get(s, 0) / n - self.seen[q].get(s, 0) / m) > limit:
                    return False
                if s in self.next[p] and s in self.next[q]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the subtree of q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for s, n in self.gave[q].items():
                self.gave[p][s] = self.gave[p].get(s, 0) + n
            for s, r in self.next[q].items():
                self.seen[p][s] = self.seen[p].get(s, 0) + self.seen[q][s]
                if s in self.next[p]:
                    todo.append((self.next[p][s], r))
                else:
                    self.next[p][s] = r

    def _merge(self) -> None:
        """Red states stay; the blue ones after them merge into a red one or become red, the most frequent first, for
        rare ones can't be told apart before their likes are red."""
        red, known = [0], {0}
        while True:
            blue = [(-self.seen[p][s], i, s) for i, p in enumerate(red) for s, q in self.next[p].items() if q not in known]
            if not blue:
                break
            _, i, s = min(blue)
            p, q = red[i], self.next[red[i]][s]
            for r in red:
                if self._alike(r, q):
                    self.next[p][s] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
                known.add(q)
        place = {q: i for i, q in enumerate(red)}
        self.next = [{s: place[r] for s, r in self.next[q].items()} for q in red]
        self.seen, self.gave, self.ends = [self.seen[q] for q in red], [self.gave[q] for q in red], [self.ends[q] for q in red]

    def step(self, q: int, s: str) -> tuple[float, int]:
        """Log-likelihood of a symbol in a state and the state after it, -1 for none."""
        c = self.classes.get(s, s)
        n = self._total(q)
        if not n or c not in self.seen[q]:
            return math.log(FLOOR), 0 if self.restart else -1
        k = self.size.get(c, 1)
        p = self.seen[q][c] / n
        if k > 1:
            # Half a count for each symbol of the class.
            p *= (self.gave[q].get(s, 0) + 0.5) / (self.seen[q][c] + 0.5 * k)
        return math.log(max(p, FLOOR)), self.next[q][c]

    def end(self, q: int) -> float:
        n = self._total(q) if q >= 0 else 0
        return math.log(max(self.ends[q] / n if n else 0, FLOOR))

    def log_likelihood(self, word: tuple[str, ...]) -> float:
        """Natural log of the likelihood of a word and its end; after the last state every symbol gets the floor."""
        q, total = 0, 0.0
        for s in word:
            if q < 0:
                total += math.log(FLOOR)
            else:
                p, q = self.step(q, s)
                total += p
        return total + self.end(q)

    def score(self, word: tuple[str, ...]) -> float:
        """Mean log-likelihood of a symbol and the end."""
        return self.log_likelihood(word) / (len(word) + 1)


def _formats(rng: random.Random, n: int) -> dict[str, list[str]]:
    """Labelled credentials of each format, made from the format's published shape."""
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    word, low, high = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits
    return {
        "ghp": ["ghp_" + pick(word, 36) for _ in range(n)],
        "xox": ["xoxb-" + pick(string.digits, 12) + "-" + pick(string.digits, 12) + "-" + pick(word, 24) for _ in range(n)],
        "sk": ["sk_live_" + pick(word, 24) for _ in range(n)],
        "aiza": ["AIza" + pick(word + "-_", 35) for _ in range(n)],
        "jwt": ["eyJ" + pick(word, rng.randint(17, 40)) + ".eyJ" + pick(word, rng.randint(30, 90)) + "." + pick(word + "-_", 43) for _ in range(n)],
        "mixed": [pick(word + "+/", 40) for _ in range(n)],
        "lower": [pick(low, 32) for _ in range(n)],
        "upper": [pick(high, 24) for _ in range(n)],
        "glpat": ["glpat-" + pick(word, 20) for _ in range(n)],
        "npm": ["npm_" + pick(word, 36) for _ in range(n)],
    }


def _ordinary(rng: random.Random, n: int) -> list[str]:
    """Tokens that aren't secrets: words, words joined by signs, paths, file names, identifiers, numbers, dates, UUIDs, rules."""
    syllables = "a an be by con cu de do en er fi for ge go ha he in ing it jo ka lo ly ma me ment na no on or ph pre qui re sch sy ta ti tion un ver vo wi ex zu ze".split()
    word = lambda a, b: "".join(rng.choice(syllables) for _ in range(rng.randint(a, b)))
    number = lambda a, b: "".join(rng.choice(string.digits) for _ in range(rng.randint(a, b)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    makers = [
        lambda: word(1, 4),
        lambda: word(1, 3).capitalize(),
        lambda: word(6, 12),
        lambda: word(2, 12).upper(),
        lambda: word(6, 10).capitalize() + number(1, 3),
        lambda: word(1, 3) + "".join(word(1, 3).capitalize() for _ in range(rng.randint(1, 6))) + rng.choice(["", "", number(1, 2), "URL", "ID", "NS"]),
        lambda: "-".join(word(1, 4) for _ in range(rng.randint(2, 7))),
        lambda: "/".join(word(1, 4) for _ in range(rng.randint(2, 7))),
        lambda: "_".join(word(1, 4) for _ in range(rng.randint(2, 7))),
        lambda: "_".join(word(1, 3).upper() for _ in range(rng.randint(2, 5))),
        lambda: ".".join(word(1, 4) for _ in range(rng.randint(2, 6))),
        lambda: "-".join(rng.choice([word(1, 3), number(1, 6)]) for _ in range(rng.randint(2, 6))),
        lambda: "_".join(rng.choice([word(1, 2).upper(), number(2, 8)]) for _ in range(rng.randint(2, 5))) + rng.choice(["", ".jpg", ".pdf", ".html"]),
        lambda: word(2, 4) + "-" + ".".join(number(1, 3) for _ in range(rng.randint(2, 4))) + "-" + word(1, 3),
        lambda: word(2, 4) + number(1, 4) + "/" + word(2, 4) + "/" + word(2, 4) + number(1, 2) + ".html",
        lambda: number(1, 30),
        lambda: "-".join(number(1, 7) for _ in range(rng.randint(2, 7))),
        lambda: ".".join(number(1, 3) for _ in range(rng.randint(2, 5))),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}",
        lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)),
        lambda: rng.choice("-=_+./") * rng.randint(1, 80),
    ]
    return [rng.choice(makers)() for _ in range(n)]


class Grammars:
    """The automata of all formats and of ordinary tokens, also stacked as tables.

    State 0 of the tables is the one that has left its format. The ordinary automaton is the last of all.
    """

    def __init__(self, each: int = 600, ordinary: int = 6000, seed: int = 42):
        rng = random.Random(seed)
        self.formats = {k: Automaton(list(map(tuple, ws)), LENGTHS) for k, ws in _formats(rng, each).items()}
        self.plain = Automaton(list(map(tuple, _ordinary(rng, ordinary))), KIND_OF, restart=True)
        every = [*self.formats.values(), self.plain]
        first = np.cumsum([1] + [len(a.next) for a in every])
        self.start, n, k = first[:-1].astype(np.int32), int(first[-1]), len(ALPHABET)
        self.after, self.said, self.end = np.zeros((n, k), np.int32), np.full((n, k), math.log(FLOOR)), np.full(n, math.log(FLOOR))
        for a, base in zip(every, self.start.tolist()):
            for q in range(len(a.next)):
                self.end[base + q] = a.end(q)
                for j, s in enumerate(ALPHABET):
                    self.said[base + q, j], to = a.step(q, s)
                    self.after[base + q, j] = base + to if to >= 0 else 0
        self.place = np.zeros(256, np.uint8)
        self.place[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(k)

    def lead(self, token: str) -> float:
        """By how much the likeliest format's log-likelihood of a token exceeds that of ordinary tokens."""
        word = tuple(token)
        return max(a.log_likelihood(word) for a in self.formats.values()) - self.plain.log_likelihood(word)

    def secret(self, tokens: list[str], margin: float = MARGIN) -> np.ndarray:
        """Which tokens a format leads by the margin."""
        out = np.zeros(len(tokens), bool)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = self.place[np.frombuffer("".join(tokens).encode(), np.uint8)]
        begin = np.cumsum(size) - size
        who = np.arange(len(tokens))
        state = np.repeat(self.start[None, :], len(tokens), axis=0)
        total = np.zeros(state.shape)
        at = 0
        while len(who):
            done = size[who] == at
            if done.any():
                last = total[done] + self.end[state[done]]
                out[who[done]] = last[:, :-1].max(axis=1) - last[:, -1] > margin
                who, state, total = who[~done], state[~done], total[~done]
            s = flat[begin[who] + at][:, None]
            total += self.said[state, s]
            state = self.after[state, s]
            at += 1
            # Behind the last state a format loses by every further symbol, for nothing is less likely than the floor.
            over = ~state[:, :-1].any(axis=1)
            if over.any():
                over[over] = total[over, :-1].max(axis=1) - total[over, -1] <= margin
                who, state, total = who[~over], state[~over], total[~over]
        return out


class Known:
    """Verdicts on tokens seen before, at most so many and not of very long ones."""

    def __init__(self, grammars: Grammars, limit: int = 200_000, longest: int = 200):
        self.grammars, self.limit, self.longest = grammars, limit, longest
        self.told: dict[str, bool] = {}

    def secret(self, tokens: set[str]) -> set[str]:
        if len(self.told) > self.limit:
            self.told = {}
        new = [t for t in tokens if t not in self.told]
        verdict = dict(zip(new, self.grammars.secret(new).tolist()))
        self.told.update((t, v) for t, v in verdict.items() if len(t) <= self.longest)
        return {t for t in tokens if verdict.get(t) or self.told.get(t)}


def format_spans(texts: list[str], base: list[list[Span]], known: Known) -> list[list[Span]]:
    """For each text the candidates that a format's automaton explains better, without those that overlap a base span."""
    found = known.secret(set().union(*map(CANDIDATE.findall, texts)))
    out: list[list[Span]] = []
    for text, held in zip(texts, base):
        out.append([])
        if found and not found.isdisjoint(CANDIDATE.findall(text)):
            spans_ = [m.span() for m in CANDIDATE.finditer(text) if m.group() in found]
            out[-1] = [("format", a, b) for a, b in spans_ if not any(a < y and x < b for _, x, y in held)]
    return out


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def spans(texts: list[str], known: Known) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, each by start and kind."""
    base = [sorted(base_spans(t), key=_order) for t in texts]
    return [(b, sorted(b + f, key=_order)) for b, f in zip(base, format_spans(texts, base, known))]


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of spans by kind, the SHA-256 of the base spans as written, and all spans as written."""
    # Inferred once; the tables are of a fixed size.
    grammars = docs.sparkSession.sparkContext.broadcast(Grammars())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(grammars.value)
        for part, texts in text_parts(batches):
            counts, shas, all_spans = [], [], []
            for base, every in spans(texts, known):
                counts.append([sum(k == kind for k, _, _ in every) for kind in KINDS])
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(every))
            cols = list(zip(*counts)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(shas, pa.string()), pa.array(all_spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)
