"""Small inputs with every odd case, and plain second opinions on the text operators."""

from __future__ import annotations

import re

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, node int, batch int, gone string, held int, log_weight string, kept_id string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def odd_documents() -> list[tuple]:
    """Null and empty texts, null and repeated ids, copies, near copies, shared passages, one very long text, one very long word."""
    base, passage = sentence(1, 120), sentence(2, 70)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "short"), (8, "two words"),
        (9, sentence(3, 30) + " " + passage + " " + sentence(4, 40)), (10, sentence(5, 50) + "\n" + passage), (10, sentence(6, 20)),
        (11, sentence(7, 15) + "\n" + sentence(8, 20) + "\nsame line of text here\n" + sentence(9, 9)),
        (12, "same line of text here\nsame line of text herf\nsame line of text her\n" + sentence(10, 30)),
        (12, "same line of text here\nsame line of text herf\nsame line of text her\n" + sentence(10, 30)),
        (None, sentence(11, 60)), (None, base), (13, "x" * 5000), (14, "12345 !!! ???"), (15, "ab " * 400), (16, sentence(12, 6000)),
        (17, "Ä ö é 日本語   　 x\u0085y 'S it's <|endoftext|> a<|startoftext|>b \U0001f642\U0001f642"), (18, sentence(2, 70)),
    ]
    return [(i, t, "aa" if k % 3 else None, "s", None if t is None else len(t), "k", "l", k, k, "g", 0, "w", "y") for k, (i, t) in enumerate(texts)]


def shingle_set(text: str | None, n: int = 5) -> set:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def similar(a: set, b: set) -> bool:
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def covered(texts: list[bytes], length: int) -> list[bytearray]:
    """Bytes under a string of `length` bytes that starts at two places at least."""
    seen: dict[bytes, int] = {}
    for x in texts:
        for k in range(len(x) - length + 1):
            seen[x[k : k + length]] = seen.get(x[k : k + length], 0) + 1
    out = []
    for x in texts:
        gone, last = bytearray(len(x)), 0
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[max(k, last) : k + length] = b"\1" * (k + length - max(k, last))
                last = k + length
        out.append(gone)
    return out
