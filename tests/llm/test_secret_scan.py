import random
import re

from evidra.llm import secret_scan as s


def brute(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], s.KINDS.index(x[0])))


def test_base_is_exact():
    rng = random.Random(1)
    parts = ["token", "Secret", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "ſecret", "PASSWORD", ".", "Z9"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert sorted(s.base_spans(text), key=lambda x: (x[1], s.KINDS.index(x[0]))) == brute(text)


def test_formats_are_told_from_words():
    known, rng = s.Grammars(), random.Random(99)
    for kind, words in s._formats(rng, 100).items():
        assert sum(known.lead(w) > s.MARGIN for w in words) >= 97, kind
    plain = [w for w in s._ordinary(rng, 1500) if s.CANDIDATE.fullmatch(w) and any(map(str.isdigit, w)) and not w.isdigit()]
    assert len(plain) > 100 and sum(known.lead(w) > s.MARGIN for w in plain) <= len(plain) // 50


def test_merging_generalises():
    words = [tuple("ab" * k) for k in range(1, 9) for _ in range(20)]
    automaton = s.Automaton(words)
    assert len(automaton.next) <= 4
    assert automaton.score(tuple("ab" * 30)) > automaton.score(tuple("ba" * 30)) + 2


def test_scan(spark):
    key = "ghp_" + "aZ3kQ9mX2c" * 3 + "bN4vB7"
    rows = [(1, f"é token = abcdef123 and {key}."), (2, None), (None, ""), (1, "AKIA" + "Q7" * 8), (4, "x " * 50000 + "f0" * 12)]
    got = s.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")).collect()
    by = sorted((r["doc_id"] or 0, r["spans"]) for r in got)
    assert by == [(0, ""), (1, "access:0:20"), (1, f"assign:2:19,format:24:{24 + len(key)}"), (2, ""), (4, "hex:100000:100024")]
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_give_the_scores_of_the_automata():
    """The stacked tables and the early end against each automaton walked symbol by symbol, on every kind of token."""
    known, rng = s.Grammars(), random.Random(5)
    tokens = s._ordinary(rng, 1500) + [w for ws in s._formats(rng, 40).values() for w in ws]
    tokens += ["".join(rng.choice(s.ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(500)] + [t[:-1] for t in tokens[-300:]] + ["a" * 5000]
    slow = [max(a.score(tuple(t)) * (len(t) + 1) for a in known.formats.values()) - known.plain.log_likelihood(tuple(t)) for t in tokens]
    for margin in (s.MARGIN, 0.0, -5.0):
        assert known.secret(tokens, margin).tolist() == [x > margin for x in slow]


def test_length_and_prefix_count():
    """A key that is cut or has a wrong prefix is less likely, by about the floor."""
    known, rng = s.Grammars(), random.Random(6)
    for kind in ("ghp", "sk", "glpat", "npm"):
        for w in s._formats(rng, 30)[kind]:
            a = known.formats[kind]
            assert a.log_likelihood(tuple(w)) > a.log_likelihood(tuple(w[:-1])) + 3 and a.log_likelihood(tuple(w)) > a.log_likelihood(tuple("#" + w[1:])) + 100


def test_ordinary_tokens_are_left_alone():
    """File names, identifiers, numbers and words of shapes that the ordinary set doesn't have."""
    known, rng = s.Grammars(), random.Random(7)
    tokens = ["978-3-16-148410-0-2019-05", "IMG_20190504_123456_HDR.jpeg", "linux-image-5.4.0-42-generic", "getElementsByTagNameNS2ToString", "+49-170-1234567-0001-ext", "XMLHttpRequestEventTarget2Element",
              "Donaudampfschiffahrtsgesellschaftskapitaen", "com/example/service/impl/DefaultHandlerFactoryBean.java", "2019-05-04T12-34-56Z", "DE89370400440532013000", "v1.2.3-rc.4", "SSer", "0" * 40, "a" * 32, "A" * 24]
    assert not any(known.secret(tokens))
    assert sum(known.secret(s._ordinary(rng, 20_000))) <= 20


def test_spans_against_a_plain_scan():
    known, rng = s.Grammars(), random.Random(8)
    parts = [lambda: rng.choice(s._ordinary(rng, 1)), lambda: rng.choice(list(s._formats(rng, 1).values()))[0], lambda: "token=" + "x1" * 5, lambda: rng.choice([" ", ".", ", ", "\n", "é", "=", '"'])]
    texts = ["".join(rng.choice(parts)() for _ in range(rng.randint(0, 20))) for _ in range(80)]
    for text, (base, every) in zip(texts, s.spans(texts, s.Known(known))):
        held = brute(text)
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}", text) if known.lead(m[0]) > s.MARGIN]
        more = [("format", *m.span()) for m in runs if not any(m.start() < b and a < m.end() for _, a, b in held)]
        assert base == held and every == sorted(held + more, key=lambda x: (x[1], s.KINDS.index(x[0])))
