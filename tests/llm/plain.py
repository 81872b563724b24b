"""Plain versions of what the operators do, for comparison."""

from evigrid.llm.line_dedup import LEAST_CHARS, normal


def brute_force(texts: list[tuple[int, str | None]], least: int = LEAST_CHARS) -> set[tuple[int, int]]:
    """The lines that go, by comparing all pairs."""
    lines = sorted((d, i, normal(x)) for d, t in texts for i, x in enumerate((t or "").split("\n")) if normal(x))

    def near(a: str, b: str) -> bool:
        if a == b:
            return True
        if min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    return {(d, i) for k, (d, i, x) in enumerate(lines) if any(near(x, y) for _, _, y in lines[:k])}
