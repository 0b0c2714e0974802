"""Plain versions of what the operators promise, and tables of awkward rows."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(spark, more=()):
    """NULLs in every column, blank and long texts, ties, repeated rows, odd blanks, clashing extra columns."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = say(70), say(6000)
    rows = [
        (1, say(80), "en", "s1", 1),
        (2, f"{say(30)} {passage} {say(20)}", "en", "s1", 1),
        (3, f"{passage}\n{say(40)}", None, "s2", None),
        (4, None, "en", "s2", 0),
        (5, "", "en", "s2", 0),
        (6, " \t\n\x0b\x0c\r ", "en", None, 7),
        (7, long, "de", None, 1),
        (8, long, "de", "s1", 1),
        (9, f"{say(25)} {passage} {passage}", "fr", "s3", 1),
        (10, "one", "en", "s1", 3),
        (11, "ONE", "en", "s1", 3),
        (12, "a b c d\x1ce \x85 f", "en", "s1", 9),
        (13, ("same words again " * 40).strip(), "en", "s1", 9),
        (13, ("same words again " * 40).strip(), "en", "s1", 9),
        (None, f"{passage} {say(30)}", "en", "s1", 9),
        (None, None, None, None, None),
        (14, "é " + long[: len(long) // 2] + " Ünïcode 😀 end", "es", "", 5),
        *more,
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["block", "rep", "score", "words", "kept", "offset", "size", "row"]
    for name in names:
        df = df.selectExpr("*", f"'clash' as {name}")
    return df, rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(docs, width):
    """Per row the word positions in windows that start in a document with a smaller doc_id."""
    first = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            w = words(text)
            for p in range(len(w) - width + 1):
                key = tuple(w[p : p + width])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in docs:
        w, gone = words(text), set()
        for p in range(len(w) - width + 1 if doc_id is not None else 0):
            if first[tuple(w[p : p + width])] < doc_id:
                gone |= set(range(p, p + width))
        out.append((doc_id, w, gone))
    return out
