"""Small documents with the awkward cases every operator must handle."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row_id string, size string, chunk string, h string, kept string, key string, target string, u string")


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    words = [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    return " ".join(words)


def awkward_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows and ids, copies that differ
    in white space, near copies, repeated passages, one very long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \t\n\x0b\f\r "), (103, "one"), (104, "One two"), (None, None),
             (None, "one"), (None, base[3])]
    rows += [(105, base[0].replace(" ", "\n ")), (106, base[0]), (0, base[0]), (0, base[0])]
    rows += [(110 + i, f"{base[i][:80]} {passage} {base[i][80:]}") for i in range(5)]
    for i in range(12):
        words = base[7 + i].split() + passage.split()
        words[rng.randrange(len(words))] = "edited"
        rows += [(200 + 2 * i, base[7 + i] + " " + passage), (201 + 2 * i, " ".join(words))]
    rows += [(300, "Ünïcode — 漢字   nbsp em \U0001f600 " * 4), (301, "a b c a b c a b c"),
             (302, "#*$%&|<> text\nline\nline\n\nline!"), (303, "<|endoftext|> it's  John's\n\n\nend "),
             (304, prose(rng, 30_000, 5000)), (305, "x" * 20_000)]
    return rows


def frame(spark, rows=None, sources=("src0", "src1", None)):
    rows = awkward_texts() if rows is None else rows
    out = [(i, t, "en", sources[k % len(sources)] if sources else None, None if t is None else len(t),
            "r", "s", "c", "h", "k", "key", "t", "u") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def table(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
