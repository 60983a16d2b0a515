"""Documents with nulls, empty and long texts, ties, repeated rows, null ids and columns with clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, start int, slot int, places string, node long"
LEXICON = {
    "en": "the of and to in that was with from this which have there their would about could these other after being between through water house little people".split(),
    "de": "der die und das nicht ist mit sich auch eine werden haben über größe straße können müssen zwischen haus wasser leute kleine schön für während".split(),
    "fr": "le la les des une pour dans avec être très maison petite eau gens où après entre élève façon garçon qui que sur pas nous vous".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(LEXICON[lang]) + rng.choice(["", "", "", "s", "er", ","]) + (rng.choice("abcdefgh") if rng.random() < 0.3 else ""))
        out.append("\n" if k % 17 == 16 else rng.choice([" ", " ", " ", "  ", "\t"]))
    return "".join(out)


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["changed", "Other", "wörter", ""])
    return " ".join(words)


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out, texts, shared = [], [], prose(rng, "en", 70)
    for k in range(n):
        lang = rng.choice(list(LEXICON))
        text = prose(rng, lang, rng.choice([1, 3, 30, 80, 200]))
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.4:
            text = edited(rng, rng.choice(texts), rng.choice([1, 2, 4]))
        elif kind < 0.5:
            text = prose(rng, lang, 20) + shared + prose(rng, lang, 5)
        texts.append(text)
        out.append((k * 3 - 30, text, lang if rng.random() < 0.9 else None, rng.choice(["a", "b", "ß", None, "a"]), len(text)))
    long = prose(rng, "de", 9000)
    out += [(1000, None, "en", "a", None), (1001, "", None, None, 0), (1002, " \n\t ", "fr", "b", 4), (1003, "12 !? 34", "en", "b", 8), (1004, long, "de", "long", len(long))]
    out += [(1005, "one", "en", "a", 3), (1006, "ONE", "en", "a", 3), (1007, "one  two", "en", "a", 8), (1008, "aaaa " * 90, "en", "a", 450), (1009, "aaaa " * 90, "en", "a", 450)]
    out += [out[5], out[5], (None, texts[7], "en", None, 1), (None, None, None, None, None), (out[9][0], texts[20], "en", "a", 7)]
    rng.shuffle(out)
    return [(*r, 7, -1, 3, 9, "x", 2) for r in out]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)
