"""Static audit of notebooks: order of execution, seeds, fitting before or on the test split."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_SEEDS = ("random_state", "manual_seed", "set_seed", "random.seed", "seed(")
_SPLIT = "train_test_split"


def _name(f: ast.expr) -> str:
    parts = []
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    return ".".join([*([f.id] if isinstance(f, ast.Name) else []), *reversed(parts)])


def _names(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


def audit(text: str) -> list[tuple[str, str]]:
    """(code, message) of what a notebook's JSON shows; nothing in it is run."""
    out = []
    try:
        cells = [c for c in json.loads(text)["cells"] if c.get("cell_type") == "code"]
    except (ValueError, KeyError, TypeError, AttributeError):
        return [("unreadable_notebook", "not a notebook")]
    counts = [c.get("execution_count") for c in cells if c.get("execution_count") is not None]
    if counts != sorted(counts) or len(set(counts)) != len(counts):
        out.append(("non_monotonic_notebook_execution", f"execution counts {counts}"))
    sources = ["".join(c.get("source", "")) if isinstance(c.get("source"), list) else str(c.get("source", "")) for c in cells]
    if sources and not any(s in x for x in sources for s in _SEEDS):
        out.append(("random_seed_not_detected", "no seed is set"))
    trees, bad = [], 0
    for s in sources:
        try:
            trees.append(ast.parse("\n".join(x for x in s.split("\n") if not x.lstrip().startswith(("%", "!")))))
        except SyntaxError:
            bad += 1
    if bad:
        out.append(("unparsed_notebook_cells", f"{bad} cells"))
    split_at, fits, position = None, [], 0
    tainted: set[str] = set()
    for tree in trees:
        for node in ast.walk(tree):
            if isinstance(node, ast.Assign):
                targets = [t for x in node.targets for t in (x.elts if isinstance(x, ast.Tuple) else [x])]
                is_split = isinstance(node.value, ast.Call) and _name(node.value.func).endswith(_SPLIT)
                for i, t in enumerate(targets):
                    if isinstance(t, ast.Name) and (is_split and i % 2 == 1 or "test" in t.id.lower() or _names(node.value) & tainted and not is_split):
                        tainted.add(t.id)
        for node in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset)):
            position += 1
            name = _name(node.func)
            if name.endswith(_SPLIT) and split_at is None:
                split_at = position
            if name.endswith((".fit", ".fit_transform")):
                fits.append((position, name, set().union(*map(_names, node.args)) if node.args else set()))
    if split_at is not None and any(p < split_at for p, _, _ in fits):
        out.append(("preprocessing_before_split", "fit before the split"))
    if any("test" in a.lower() for _, _, args in fits for a in args):
        out.append(("fit_on_test_data", "fit on a name of test data"))
    elif any(args & tainted for _, _, args in fits):
        out.append(("fit_on_test_dataflow", "fit on what comes from test data"))
    return out


def audit_notebooks(notebooks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, message) of each finding of each notebook."""
    kind = notebooks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *f) for k, t in zip(b[key], b[text]) for f in audit(t or "")], columns=[key, "code", "message"])

    return notebooks.select(key, text).mapInPandas(run, f"{key} {kind}, code string, message string")
