"""The contracts of the corpus operators, row by row and without thought for speed."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def joined(spans) -> str:
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(spans))


def secrets(text: str) -> list:
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def luhn(d: str) -> bool:
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def personal(text: str) -> list:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def rules(text: str) -> tuple[int, int, int, int, int]:
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(grams)
    hit = {k + d for k, g in enumerate(grams) if c[g] >= 2 for d in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(hit)


def exact(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g), i == min(g), sha(n)) for n, g in groups.items() for i in g}


def fingerprint(text: str) -> int:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    fps = {i: fingerprint(t or "") for i, t in rows}
    by: dict[int, list[int]] = {}
    for i, f in fps.items():
        by.setdefault(f, []).append(i)
    keys, parent = list(by), {f: f for f in by}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 2:
                parent[find(keys[a])] = find(keys[b])
    least: dict[int, int] = {}
    for f, ids in by.items():
        least[find(f)] = min(least.get(find(f), 1 << 62), *ids)
    return {i: (f"{f:016x}", least[find(f)]) for i, f in fps.items()}


def similar_pairs(rows: list[tuple[int, str | None]], shingle: int = 5) -> list[tuple[int, int]]:
    """Pairs of ids whose sets of word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or {tuple(w)}
    return [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def similar(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Each id's smallest id that chains of similar texts reach."""
    least = {i: i for i, _ in rows}
    pairs = similar_pairs(rows)
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def unit_draws(doc_id: int) -> list[int]:
    h = sha(f"1:{doc_id}")
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def middle(doc_id: int, text: str) -> tuple:
    """(n, form, prefix length, middle length, output) of the fill-in-middle transformation."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, (h1, h2, h3, h4) = len(units), unit_draws(doc_id)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def small(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(t))
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def after_damage(rows: list[tuple]) -> list[tuple]:
    """(conv_id, turn, role, text) after damage."""
    import zlib

    out = []
    for c, t, role, text in rows:
        blank = lambda x: " " if x is None else x
        act = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out += [(c, t, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    return out


def repaired(rows: list[tuple]) -> dict:
    """Per conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), by a forward search of all prefixes."""
    out = {}
    left = after_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            said = WORD.findall(text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        pattern = re.compile("(s?(ua)+)?")
        # every sequence of roles so far that can still be completed, by its last two initials; ties by the audit itself
        best = {"": (0, "", [])}

        def inserted(best):
            for _ in range(3):
                for q, (c, a, rows_) in list(best.items()):
                    role = "assistant" if q.endswith("u") else "user"
                    new = state(q + role[0])
                    if new not in best or (c + 5, a + "I") < best[new][:2]:
                        best[new] = (c + 5, a + "I", [*rows_, (role, "")])
            return best

        def state(q):
            return q if len(q) < 2 and q in ("", "s") else "u" if q.endswith("u") else "a"

        for (_, _, role, text), fault in zip(own, faults):
            best, now = inserted(best), {}

            def offer(q, c, a, rows_):
                if q not in now or (c, a) < now[q][:2]:
                    now[q] = (c, a, rows_)

            for q, (c, a, rows_) in best.items():
                offer(q, c + 2, a + "D", rows_)
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 * (fault == "truncated")
                for new, edit, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    initial = new[:1]
                    fits = initial == "s" and q == "" or initial == "u" and q in ("", "s", "a") or initial == "a" and q == "u"
                    if fits:
                        offer(state(q + initial), c + cost + more, a + edit, [*rows_, (new, text)])
            best = now
        best = inserted(best)
        cost, audit, rows_ = min((v for q, v in best.items() if q in ("", "a")), key=lambda v: v[:2])
        assert pattern.fullmatch("".join(r[:1] for r, _ in rows_))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in rows_)),
        )
    return out
