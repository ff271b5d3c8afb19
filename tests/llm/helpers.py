import random

ODD = [(None, "no id", "a"), (1, None, "b"), (2, "", "a"), (3, " \n ", None), (4, "The same line.\nand more", "a"),
       (5, "The same line.\nand more", "b"), (5, "The same line.\nand more", "b"), (6, "word " * 60_000, "a"), (-7, "é ñ 中 \U0001F600", "c")]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties and columns with the names operators use."""
    rows = [(i, t, s, 0.5, 9, "x", "y") for i, t, s in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, score double, tokens long, whole_text string, cut_lines string")


def none(spark):
    return odd(spark).where("false")


def prose(rng: random.Random, words: int, vocabulary: int = 300) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
