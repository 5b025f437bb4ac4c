"""Small tables with every awkward row: nulls, empty and very long texts, copies, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, version string, row string, size string, v string"


def words(rng: random.Random, n: int, letters: str = "abcde") -> str:
    seps = [" ", " ", " ", "\n", "  ", "\t"]
    return "".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) + rng.choice(seps) for _ in range(n)).rstrip("\t ")


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 40)
    texts: list[str | None] = [None, "", "   \n\t", "one", "two words", "ÄÖ ü ñ!", "12 34", words(rng, 4), words(rng, 20_000)]
    for i in range(40):
        text = words(rng, rng.randint(10, 120), "abcde" if i % 2 else "vwxyé")
        texts.append(text if i % 5 else f"{text} {passage} {words(rng, 8)}")
    texts += [texts[12], texts[12], texts[13] + " tail", "start " + texts[14]]
    out = []
    for i, text in enumerate(texts):
        lang = None if i % 11 == 3 else ("xx", "yy")[i % 2]
        source = None if i % 9 == 4 else f"s{i % 3}"
        out.append((i * 3 % 160, text, lang, source, len(text or ""), "s", "w", "r", "z", "v"))
    out.append((None, texts[20], None, None, 3, "s", "w", "r", "z", "v"))
    return out + [out[15], out[15]]  # equal rows


def docs(spark, given: list[tuple] | None = None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
