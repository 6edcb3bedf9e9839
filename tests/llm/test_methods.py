"""The named methods on their own: automaton, prefix counts, bit slicing, trees, PU risk, deobfuscation."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import bpe, pii, pu_quality, quality_rules, simhash, token_counts
from marketloom.llm.document_stats import counts
from tests.llm import brute


def by_merges(word: bytes, ranks: dict) -> list[bytes]:
    parts = [bytes([b]) for b in word]
    while True:
        best = min((ranks[p] for p in zip(parts, parts[1:], strict=False) if p in ranks), default=None)
        if best is None:
            return parts
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and ranks.get((parts[k], parts[k + 1])) == best:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


@st.composite
def vocabularies(draw):
    """Random proper merge lists over three letters: both parts exist, no result is made twice."""
    tokens, merges = [b"a", b"b", b"c"], []
    for _ in range(draw(st.integers(0, 14))):
        u, v = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        if u + v not in tokens and len(u + v) < 9:
            # a proper list: the parts meet when only earlier merges have been made
            ranks = {m: k for k, m in enumerate(merges)}
            if by_merges(u + v, ranks) == [u, v]:
                tokens.append(u + v)
                merges.append((u, v))
    return tokens, merges


@settings(max_examples=150, deadline=None)
@given(vocabularies(), st.lists(st.text("abc", min_size=1, max_size=18), min_size=1, max_size=8))
def test_automaton_is_bpe(v, words):
    tokens, merges = v
    vocab = {t.decode(): k for k, t in enumerate(tokens)}
    a = bpe.Automaton(vocab, [(u.decode(), w.decode()) for u, w in merges], {})
    ranks = {m: k for k, m in enumerate(merges)}
    for w in words:
        want = [vocab[p.decode()] for p in by_merges(w.encode(), ranks)]
        assert a.encode_word(w.encode()) == want
        assert a.prefixes(w.encode()) == [0] + [len(by_merges(w[:k].encode(), ranks)) for k in range(1, len(w) + 1)]
        assert a.decode(want) == w


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab' \n\t're1é日!<| "), max_size=40))
def test_prefix_table(text):
    c = token_counts.counter(bpe.vocabulary("byte_bpe_50k.json"))
    text = text.replace("<|", "<|endoftext|>")
    table = c.table(text)
    assert table == [c.count(text[:k]) for k in range(len(text) + 1)]
    for limit in (0, 1, 3):
        assert c.fits(text, limit) == max(k for k, n in enumerate(table) if n <= limit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.lists(st.integers(0, 63), max_size=40))
def test_bit_slices(values, flips):
    for k, b in enumerate(flips):
        values.append(values[k % len(values)] ^ (1 << b))
    x = np.array(values, np.uint64)
    for radius in (1, 2, 3):
        i, j = simhash.within(x, x, radius)
        want = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, want), strict=True))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b*#é "), max_size=60))
def test_statistics(text):
    assert counts(text)[:5] == brute.rules(text)
    assert simhash.fingerprint(text) == brute.fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab.@-+0123456789 ()é%"), max_size=80))
def test_base_spans(text):
    assert [(s, k, e) for s, k, _, e in brute.personal(text)] == pii.base_spans(text)


def found(text):
    base, every = pii.all_spans(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in every if (s, k, e) not in base]


def test_deobfuscation_maps_back():
    assert found("write to jane (at) example (dot) com today") == [("email", "jane (at) example (dot) com")]
    assert found("write to jane at example dot com today") == [("email", "jane at example dot com")]
    assert found("jаne@exаmple.com") == [("email", "jаne@exаmple.com")]  # Cyrillic letters
    assert found("call +one two three four five five five zero one two three now") == [("phone", "+one two three four five five five zero one two three")]
    assert found("call plus one two three four five five five zero one two three now") == [("phone", "plus one two three four five five five zero one two three")]
    assert found("card ４１１１ １１１１ １１１１ １１１１ ok") == [("card", "４１１１ １１１１ １１１１ １１１１")]
    assert found("192​.168.0.1") == [("ip", "192​.168.0.1")]
    for clean in ("look at the dot on one page", "un deux trois", "the point at which we met (at noon)", "é à ü ñ", "a.b@c.de"):
        assert found(clean) == []


def test_spelled_digits_keep_their_own_places():
    one, two = "plus one two three four five five five zero one two three", "plus four four two zero seven nine four six zero nine five eight"
    assert found(f"call {one} {two} now") == [("phone", one), ("phone", two)]
    assert found(f"call {one}, {two} now") == [("phone", one), ("phone", two)]
    assert found(f"one two three {two}") == [("phone", two)]
    assert found("host one nine two dot one six eight dot zero dot one is up") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert found("host one.two.three.four is up") == [("ip", "one.two.three.four")]
    card = "four one one one one one one one one one one one one one one one"
    assert found(f"pay by {card} today") == [("card", card)]
    m = pii.spelled_digits(("a one two three", list(range(15)), list(range(1, 16))))
    assert m[0] == "a 123" and [(a, b) for a, b in zip(m[1][2:], m[2][2:], strict=True)] == [(2, 5), (6, 9), (10, 15)]


NAMES = "zero one two three four five six seven eight nine".split()


@st.composite
def disguised_identifiers(draw):
    """(kind, disguised form) of an identifier that the text as it is shows at most in part."""
    word = st.text("bdfgkmnqrtwz", min_size=4, max_size=8)
    kind = draw(st.sampled_from(["email", "phone", "ip", "card"]))
    if kind == "email":
        name, host = draw(word) + "7", draw(word)
        form = draw(st.sampled_from(["{n} [at] {h} [dot] com", "{n} (at) {h} (dot) org", "{n} at {h} dot com", "{n}@{h} dot net", "{n}{{at}}{h}{{dot}}com", "{n}\u043e@{h}.com", "{n}@{h}\u0435.com", "{n}\u200b@{h}.com"]))
        return kind, form.format(n=name, h=host)
    if kind == "phone":
        digits = draw(st.lists(st.integers(0, 9), min_size=10, max_size=15))
        return kind, draw(st.sampled_from(["plus ", "+"])) + draw(st.sampled_from([" ", ", ", "-"])).join(NAMES[d] for d in digits)
    if kind == "ip":
        parts = draw(st.lists(st.integers(0, 255), min_size=4, max_size=4))
        if draw(st.booleans()):
            return kind, " dot ".join(map(str, parts))
        return kind, draw(st.sampled_from([" dot ", " point "])).join(" ".join(NAMES[int(c)] for c in str(p)) for p in parts)
    digits = draw(st.lists(st.integers(0, 9), min_size=15, max_size=15))
    check = next(c for c in range(10) if pii.luhn("".join(map(str, [*digits, c]))))
    wide = draw(st.booleans())
    return kind, "".join(chr(0xFF10 + d) for d in [*digits, check]) if wide else " ".join(NAMES[d] for d in [*digits, check])


@settings(max_examples=400, deadline=None)
@given(st.lists(disguised_identifiers(), min_size=1, max_size=4), st.sampled_from(["; call. ", " \u2014 ", "\n", " und, dann: "]))
def test_disguised_identifiers_are_found_where_they_stand(items, gap):
    text, want = "x" + gap, []
    for kind, form in items:
        want.append((len(text), pii.KINDS.index(kind), len(text) + len(form)))
        text += form + gap
    base, every = pii.all_spans(text)
    assert set(want) <= set(every), (text, want, every)
    assert set(base) <= set(every) and all(0 <= s < e <= len(text) for s, _, e in every)


def test_fragments_in_the_text_do_not_hide_whole_identifiers():
    for text, whole in (
        ("to jоhn.smith@example.com now", "jоhn.smith@example.com"),  # Cyrillic o: the text as it is shows hn.smith@example.com
        ("to john@mail.exаmple.com now", "john@mail.exаmple.com"),
    ):
        assert found(text) == [("email", whole)]
        assert len(pii.all_spans(text)[0]) == 1  # the fragment stays in the list
        assert pii.redacted(text) == "to <EMAIL> now"
    assert found("call +49 30 1234567 eight nine.") == [("phone", "+49 30 1234567 eight nine")]
    assert pii.redacted("call +49 30 1234567 eight nine.") == "call <PHONE>."
    assert found("a.b@c.de and ​ 192.168.0.1") == []


def test_worded_and_mixed_disguises():
    for email in (
        "john@example dot com", "john@mail.example dot com", "john.smith at example.com", "john dot smith at example.com", "jane at example (dot) com", "jane (at) example dot com",
        "ana at correo dot es", "ana at posta dot it", "max at beispiel dot at", "kim at example dot com dot au", "luz at correo dot com dot co", "bo at firma dot co",
    ):
        assert ("email", email) in found(f"write to {email}, please"), email
        assert pii.redacted(f"write to {email}, please") == "write to <EMAIL>, please"
    for ip in ("192 dot 168 dot 0 dot 1", "192.168 dot 0 dot 1"):
        assert found(f"host {ip} is up") == [("ip", ip)]
    for clean in ("look at example.com for more", "the red at the dot in the middle", "stare at the dot at noon", "look at a red dot in it", "300 dot 300 dot 300 dot 300", "see page 7 at example.com"):
        assert found(clean) == [], clean


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] - 0.8 * x[:, 1] + 0.4 * np.sin(9 * x[:, 0]) + 0.1 * rng.standard_normal(3000) > 0.1).astype(float)
    f = quality_rules.fit(x, y, np.array([1, -1, 0]))
    assert ((f.score(x) > 0.5) == y).mean() > 0.85
    grid = np.linspace(0, 1, 60)
    for other in rng.random((40, 3)):
        for k, sign in ((0, 1), (1, -1)):
            line = np.tile(other, (60, 1))
            line[:, k] = grid
            assert (np.diff(f.raw(line)) * sign >= -1e-12).all()


def test_positive_unlabelled_risk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (4000, 4)), rng.normal(-1, 1, (4000, 4))
    unlabelled = np.concatenate([good[2000:3400], bad[:600]])
    model = pu_quality.fit(good[:2000].astype(np.float32), unlabelled.astype(np.float32), 0.7)
    assert (model.margin(good[3400:]) > 0).mean() > 0.9 and (model.margin(bad[600:]) < 0).mean() > 0.9


def test_class_prior_without_negatives():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        n = int(4000 * share)
        good, bad = rng.normal(1.5, 1, (3000 + n, 4)).astype(np.float32), rng.normal(-1.5, 1, (4000 - n, 4)).astype(np.float32)
        assert abs(pu_quality.estimated_prior(good[:3000], np.concatenate([good[3000:], bad])) - share) < 0.05
    assert pu_quality.estimated_prior(good[:5], good) == 0.5
