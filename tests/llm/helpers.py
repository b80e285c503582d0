"""Plain readings of the operators, as slow and simple as can be."""

from __future__ import annotations

import re

import xxhash

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns under names that operators use themselves.
CLASHES = ["code", "fingerprint", "held_out", "cell", "component_id", "n", "words", "spans", "rule",
           "node", "place", "label", "u", "v"]


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def with_clashes(frame):
    return frame.selectExpr("*", *[f"'x' AS `{name}`" for name in CLASHES if name not in frame.columns])


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text: str | None, size: int = 5) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    """That of two empty sets is 1."""
    return len(a & b) / len(a | b) if a or b else 1.0


def components(n: int, linked) -> list[int]:
    """Smallest member of each one's component, by trying all pairs."""
    label = list(range(n))

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def contamination(text: str | None, items: list[tuple[str, str | None]]):
    """(words, hit places, items found)."""
    def words_of(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))

    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for at in range(len(words) - size + 1 if size else 0):
            if tuple(words[at : at + size]) in windows:
                hit.update(range(at, at + size))
                found.add(item)
    return words, hit, found


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end) straight from the patterns."""
    text = text or ""

    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in digits(s)][::-1]
        return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) < 256 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted(
        (m.start(), order, kind, m.end())
        for order, (kind, pattern, check) in enumerate(rules)
        for m in re.finditer(pattern, text)
        if check(m.group())
    )
