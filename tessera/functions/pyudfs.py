"""What needs Python's own parser, or values whose JSON type varies: plain functions and their pandas UDFs."""

from __future__ import annotations

import ast
import base64
import difflib
import functools
import io
import json
import math
import pickle
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING_OR_HASH = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)|#")


def parses(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return code is not None


def same_tree(a: str | None, b: str | None) -> bool:
    """Whether two programs have the same syntax tree; comments and layout don't count."""
    return parses(a) and parses(b) and ast.dump(ast.parse(a)) == ast.dump(ast.parse(b))


def leading_comments(code: str | None) -> str | None:
    """A comment after code moves to a line of its own above it, with the line's indent."""
    if code is None:
        return None
    out = []
    for line in code.split("\n"):
        mark = next((m.start() for m in _STRING_OR_HASH.finditer(line) if m[0] == "#"), None)
        if mark is None:
            out.append(line)
            continue
        indent = line[: len(line) - len(line.lstrip())]
        out.append(f"{indent}# {line[mark + 1 :].strip()}")
        if line[:mark].strip():
            out.append(line[:mark].rstrip())
    return "\n".join(out)


def spaces_for_tabs(code: str | None, starter: str | None = "") -> str | None:
    """Tabs as up to four spaces, where the result parses, alone or after the starter code; else unchanged."""
    if code is None:
        return None
    wide = "\n".join(x.expandtabs(4) for x in code.split("\n"))
    if parses(wide):
        return wide
    head = "\n".join(x.expandtabs(4) for x in (starter or "").split("\n"))
    return head + wide if parses(head + wide) else code


def _joined(steps: list[str]) -> str:
    """Steps in one sentence: commas between, no end mark."""
    return ", ".join(s[:-1] if s[-1:] in (".", "!", "?") else s for s in steps)


def bullets_on_top(code: str | None) -> str | None:
    """Comment runs as a list of bullets, indented like the code, above the code without its comment lines."""
    if code is None:
        return None
    rows, run, indent, rest = [], [], 0, []
    for line in [*code.split("\n"), None]:
        if line is not None and line.lstrip().startswith("#"):
            if not run:
                indent = len(line) - len(line.lstrip())
            run.append(line.lstrip()[1:].strip())
            continue
        if run:
            rows.append(_joined(["# " + " " * indent + "- " + run[0], *run[1:]]))
            run = []
        if line is not None:
            rest.append(line)
    return "\n".join(rows) + "\n" + "\n".join(rest)


def bullets_after_docstring(content: str | None) -> str | None:
    """The same below a leading docstring that stays as it is."""
    if content is None or content.count('"""') < 2:
        return bullets_on_top(content)
    cut = content.index('"""', content.index('"""') + 3) + 3
    return content[:cut] + "\n" + bullets_on_top("\n" + content[cut:].strip())


def equal_values(a: object, b: object, tolerance: float = 1e-4) -> bool:
    """Equality of nested JSON values; numbers may differ by a tolerance."""
    if isinstance(a, list | tuple) and isinstance(b, list | tuple):
        return len(a) == len(b) and all(map(equal_values, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal_values(v, b[k]) for k, v in a.items())
    if isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == b or not (math.isnan(a) or math.isnan(b)) and abs(a - b) < tolerance
    return a == b


def equal_json(a: str | None, b: str | None) -> bool:
    try:
        return equal_values(json.loads(a or "null"), json.loads(b or "null"))
    except ValueError:
        return a == b


def patched_tests(tests: str | None) -> str | None:
    """Tests of a named function: each output is its first element, each input a list. Others: list inputs become lines."""
    if tests is None:
        return None
    spec = json.loads(tests)
    if "fn_name" in spec:
        spec["outputs"] = [o[0] for o in spec["outputs"]]
        spec["inputs"] = [i if isinstance(i, list) else [i] for i in spec["inputs"]]
    else:
        spec["inputs"] = ["\n".join(map(str, i)) if isinstance(i, list) else i for i in spec["inputs"]]
    return json.dumps(spec)


def decoded_blob(blob: str | None) -> str | None:
    """Text of base64 over zlib, as it is or pickled. Of a pickle only a plain value is read, never a class; what isn't
    text is null."""
    try:
        body = b"" if blob is None else zlib.decompress(base64.b64decode(blob))
        if body[:1] == b"\x80":
            value = _Plain(io.BytesIO(body)).load()
            return value if isinstance(value, str) else None
        return None if blob is None else body.decode()
    except (ValueError, zlib.error, pickle.UnpicklingError, EOFError):
        return None


ALIKE = """def __alike__(a, b):
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(__alike__, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) < 1e-4
    return a == b
"""


def named_asserts(code: str | None, spec: str | None) -> str | None:
    """One assertion a case of a named function's tests, values written as Python's; methods of a class Solution are
    called on a new object. `fn_name` is one name or one a case."""
    if code is None or spec is None:
        return None
    tests = json.loads(spec)
    names, cases = tests["fn_name"], list(zip(tests["inputs"], tests["outputs"], strict=True))
    names = [names] * len(cases) if isinstance(names, str) else names
    owner = "Solution()." if "class Solution:" in code else ""
    return ALIKE + "".join(f"assert __alike__({owner}{name}({', '.join(map(repr, given))}), {wanted!r})\n" for name, (given, wanted) in zip(names, cases, strict=True))


def encoded_blob(text: str | None) -> str | None:
    """The pickled text in zlib in base64."""
    return None if text is None else base64.b64encode(zlib.compress(pickle.dumps(text))).decode()


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} in a blob")


def benchmark_tests(public: str | None, private: str | None, metadata: str | None) -> tuple[str | None, str | None]:
    """(all tests, public tests) as JSON specs from JSON lists of {input, output}; private tests, which come first, may
    be a blob. For a named function the input's lines and the output are JSON values, else both are texts."""
    name = json.loads(metadata or "{}").get("func_name")
    shown = json.loads(public or "[]")
    hidden = json.loads(private if private and private.lstrip()[:1] == "[" else decoded_blob(private) or "[]")

    def spec(cases: list[dict]) -> str:
        read = (lambda c: ([json.loads(x) for x in c["input"].split("\n")], json.loads(c["output"]))) if name else (lambda c: (c["input"], c["output"]))
        pairs = [read(c) for c in cases]
        out = {"inputs": [i for i, _ in pairs], "outputs": [o for _, o in pairs]}
        return json.dumps(out | {"fn_name": name} if name else out)

    return spec(hidden + shown), spec(shown)


def changed_step(code: str | None, mutated: str | None, ranges: list | None) -> tuple[int, int] | None:
    """The step range (start, end) that holds the first line in which two programs differ, or the line before it."""
    if code is None or mutated is None:
        return None
    same = 0
    for line in difflib.ndiff(code.splitlines(), mutated.splitlines()):
        if line[:1] != " ":
            break
        same += 1
    return next(((r[0], r[1]) for r in ranges or [] if r[0] <= same <= r[1] + 1), None)


#: The operators that mutations swap among one another.
SWAPS = {
    "AOR": (ast.Add, ast.Sub, ast.Mult, ast.FloorDiv, ast.Div, ast.Mod, ast.Pow),
    "LCR": (ast.And, ast.Or),
    "ROR": (ast.Gt, ast.Lt, ast.GtE, ast.LtE),
}


def _sites(tree: ast.AST) -> dict[str, list]:
    """Where each operator can act: arithmetic, logical and relational swaps, statement removal, condition negation."""
    found: dict[str, list] = {k: [] for k in (*SWAPS, "SBR", "COR")}
    for node in ast.walk(tree):
        if isinstance(node, ast.BinOp) and isinstance(node.op, SWAPS["AOR"]):
            found["AOR"].append((node, "op", None))
        if isinstance(node, ast.BoolOp):
            found["LCR"].append((node, "op", None))
        if isinstance(node, ast.Compare):
            found["ROR"] += [(node, "ops", k) for k, o in enumerate(node.ops) if isinstance(o, SWAPS["ROR"])]
        if isinstance(node, ast.If | ast.IfExp):
            found["COR"].append((node, "test", None))
        if isinstance(node, ast.comprehension):
            found["COR"] += [(node, "ifs", k) for k in range(len(node.ifs))]
        for field in ("body", "orelse", "finalbody"):
            rows = getattr(node, field, None)
            if isinstance(rows, list):
                found["SBR"] += [(node, field, k) for k, r in enumerate(rows) if isinstance(r, ast.Assign | ast.AugAssign | ast.AnnAssign | ast.Expr | ast.Return | ast.Raise | ast.Assert | ast.Delete | ast.Break | ast.Continue)]
    return {k: v for k, v in found.items() if v}


def mutate(code: str | None, seed: int = 0) -> str | None:
    """One random change: an operator that can act, then one of its sites, each with equal chance. Only the site's own
    text is written anew, so layout and comments around it stay. Code that does not parse or has no site stays as it is."""
    if not parses(code):
        return code
    draw, tree = random.Random(seed), ast.parse(code)
    sites = _sites(tree)
    if not sites:
        return code
    kind = draw.choice(sorted(sites))
    node, field, at = draw.choice(sites[kind])
    value = getattr(node, field) if at is None else getattr(node, field)[at]
    body = code.encode()
    if kind in SWAPS:
        new = draw.choice([o for o in SWAPS[kind] if not isinstance(value, o)])()
        if at is None:
            setattr(node, field, new)
        else:
            getattr(node, field)[at] = new
        begin, end = _span(body, node)
        shown = ast.unparse(node)
    else:
        begin, end = _span(body, value)
        shown = "pass" if kind == "SBR" else f"not ({body[begin:end].decode()})"
    out = (body[:begin] + shown.encode() + body[end:]).decode()
    return out if parses(out) else code


def _span(body: bytes, node: ast.AST) -> tuple[int, int]:
    """Where a node's text begins and ends, in bytes."""
    starts = [0]
    for line in body.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset


def bleu(candidate: list[str], reference: list[str], order: int = 4) -> float:
    """Sentence BLEU with uniform weights and add-one smoothing above unigrams."""
    if not candidate or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        c, r = (Counter(zip(*(x[k:] for k in range(n)), strict=False)) for x in (candidate, reference))
        hit, total, add = sum((c & r).values()), sum(c.values()), int(n > 1)
        if not hit + add:
            return 0.0
        logs += math.log((hit + add) / (total + add)) / order
    return math.exp(min(0.0, 1 - len(reference) / len(candidate)) + logs)


def bleu_sums(rows: list[dict]) -> tuple[float, int]:
    """Sum and number of the scores of a block's pairs: all of one chunk, or those across two."""
    ordered = sorted(((r["idx"], r["half"], r["value"].split()) for r in rows), key=lambda r: r[0])
    two = rows[0]["across"]
    scores = [bleu(a, b) for k, (_, x, a) in enumerate(ordered) for _, y, b in ordered[k + 1 :] if not two or x != y]
    return math.fsum(scores), len(scores)


@F.pandas_udf(T.StructType().add("total", "double").add("pairs", "long"))
def bleu_sums_udf(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bleu_sums(list(b)) for b in blocks], columns=["total", "pairs"])


def mean_pairwise_bleu(texts: list[str] | None) -> float | None:
    """Mean BLEU over all pairs i < j of a list; null for fewer than two."""
    words = [t.split() for t in texts if t is not None] if texts is not None else []
    scores = [bleu(words[i], words[j]) for i in range(len(words)) for j in range(i + 1, len(words))]
    return sum(scores) / len(scores) if scores else None


def _udf(function, returns: T.DataType):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*(None if v is None or v is pd.NA else v for v in row)) for row in zip(*columns, strict=True)], dtype="object")

    types = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    n = {"same_tree": 2, "spaces_for_tabs": 2, "equal_json": 2, "mutate": 2, "changed_step": 3, "named_asserts": 2}.get(function.__name__, 1)
    f = types[n]
    f.__annotations__ = dict.fromkeys("abc"[:n], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(f, returns)


@F.pandas_udf(T.StructType().add("tests", "string").add("public", "string"))
def benchmark_tests_udf(public: pd.Series, private: pd.Series, metadata: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([benchmark_tests(*row) for row in zip(public, private, metadata, strict=True)], columns=["tests", "public"])


@F.pandas_udf(T.StructType().add("start", "integer").add("end", "integer"))
def changed_step_udf(code: pd.Series, mutated: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """The step range that a mutation hit; nulls where it hit none."""
    found = [changed_step(c, m, list(zip(a, b, strict=True))) or (None, None) for c, m, a, b in zip(code, mutated, starts, ends, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


def token_length(vocabulary: str, pattern: str):
    """A length in tokens by a byte-level vocabulary of ranks at `vocabulary`; its own library reads it once a worker."""

    @F.pandas_udf(T.IntegerType())
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([None if t is None else len(coder.encode_ordinary(t)) for t in texts], dtype="Int32")

    return length


@functools.lru_cache(maxsize=4)
def _coder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


parses_udf = _udf(parses, T.BooleanType())
same_tree_udf = _udf(same_tree, T.BooleanType())
leading_comments_udf = _udf(leading_comments, T.StringType())
spaces_for_tabs_udf = _udf(spaces_for_tabs, T.StringType())
bullets_on_top_udf = _udf(bullets_on_top, T.StringType())
bullets_after_docstring_udf = _udf(bullets_after_docstring, T.StringType())
equal_json_udf = _udf(equal_json, T.BooleanType())
patched_tests_udf = _udf(patched_tests, T.StringType())
decoded_blob_udf = _udf(decoded_blob, T.StringType())
named_asserts_udf = _udf(named_asserts, T.StringType())
encoded_blob_udf = _udf(encoded_blob, T.StringType())
mutate_udf = _udf(mutate, T.StringType())
