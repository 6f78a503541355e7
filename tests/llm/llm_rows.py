"""Documents with every oddity that the operators define a result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}é"[: 3 + rng.randrange(4)] + rng.choice(["", "", ",", ".\n"]) for _ in range(words)).strip()


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def odd_rows() -> list[tuple]:
    """NULLs in every column, empty and long texts, exact and near copies, shared passages, repeated rows and ids."""
    base, passage = prose(1, 300), prose(2, 60)
    near = base.split(" ")
    near[150] = "changed"
    rows = [
        document(1, base), document(2, " ".join(near)), document(3, base), document(4, prose(3, 200) + "\n" + passage),
        document(5, passage + "\n" + prose(4, 150)), document(6, "x " + base), document(7, None), document(8, ""), document(9, "  \n\t "),
        document(10, "one two three"), document(11, "one two three"), document(12, prose(5, 20000, 5000)), document(None, prose(6, 50)),
        document(None, base), document(13, prose(7, 80), None, None), document(14, "same same same same same same same same same same same same"),
        document(15, prose(8, 100)), document(15, prose(8, 100)), document(16, prose(9, 90)), document(16, prose(10, 90)), document(17, "a\x00b ### | $$$ !! " * 9),
        document(18, "ÀÉ" * 120), document(19, "Ab" + "ÀÉ" * 120), document(20, "line one here\nline one here\nand another line\n" * 3),
    ]
    return [*rows, document(21, rows[3][1]), document(22, passage)]
