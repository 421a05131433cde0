"""Awkward rows that every operator on documents must bear."""

EDGES = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four"), (6, "a b c d e f g h i j"),
    (7, "A B C D E F G H I J"), (8, "x " * 30_000), (9, "x " * 30_000), (10, "é <|endoftext|> 中文\x1c z q ▁ y"), (11, "w" * 3000),
]
