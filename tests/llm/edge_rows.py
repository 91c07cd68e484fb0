"""Rows with nulls, empty and very long texts, ties and repeated rows."""

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
EDGE = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one"), (7, "one"), (7, "one"), (8, "one two three four"), (9, LONG), (10, LONG + " tail"),
    (11, "a " * 400), (12, "\n\n\n 1234 !!! \n"), (13, "日本語 テキスト ▁▁ naïve é x　y <|endoftext|> <s> 👍\x00"), (14, "same words " * 30), (15, "same words " * 30), (None, "no id here"), (None, None), (16, "x" * 50_000),
]
