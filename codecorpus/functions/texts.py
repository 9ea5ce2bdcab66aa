"""Vectorised helpers on source text that built-in expressions can't say: masking, splitting, parameters, canonical JSON."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = "([{<", ")]}>"


def split_top(text: str | None, angle: bool = False) -> list[str] | None:
    """Parts between commas outside brackets and quotes, trimmed; no empty parts."""
    if text is None:
        return None
    opening, closing = (_OPEN, _CLOSE) if angle else (_OPEN[:3], _CLOSE[:3])
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            if c == quote and text[i - 1] != "\\":
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in opening:
            depth += 1
        elif c in closing:
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (x.strip() for x in [*out, text[start:]]) if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_top_level(text: pd.Series) -> pd.Series:
    """Parts of a text between its top-level commas."""
    return text.map(split_top)


def parameter_names(signature: str | None, language: str | None) -> list[str] | None:
    """Ordered parameter names; receivers are left out; None where the list is variadic, destructured or absent."""
    if not signature or "(" not in signature:
        return None
    start, depth = signature.index("("), 0
    end = len(signature)
    for i in range(start, len(signature)):
        depth += (signature[i] == "(") - (signature[i] == ")")
        if not depth:
            end = i
            break
    out = []
    for part in split_top(signature[start + 1 : end], language == "rust") or []:
        name = re.split(r"[:=]", part, maxsplit=1)[0].strip()
        if language == "python" and name in ("*", "/"):
            continue
        if name.startswith(("*", "...", "{", "[")):
            return None
        name = re.sub(r"^(?:mut|ref|public|private|protected|readonly)\s+", "", name.lstrip("&").strip()).rstrip("?").strip()
        if name in ("self", "cls", "mut self", "this"):
            continue
        if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
            return None
        out.append(name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def parameters_of(signature: pd.Series, language: pd.Series) -> pd.Series:
    """Ordered parameter names of signatures."""
    return pd.Series([parameter_names(s, g) for s, g in zip(signature, language)])


def canonical(text: str | None, limit: int = 256 * 1024) -> str | None:
    """JSON with sorted keys and no white space; None if it isn't JSON, has a number that isn't finite or is longer than ``limit`` bytes."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
    except ValueError:
        return None
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, float) and not math.isfinite(v):
            return None
        stack += v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
    done = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return done if len(done.encode()) <= limit else None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of JSON texts, null for what can't be canonical."""
    return text.map(canonical)


def payload_hash(text):
    """SHA-256 of the canonical JSON of a JSON column."""
    return F.sha2(canonical_json(text), 256)


def mask_python(text: str) -> str:
    """The text with strings and comments blanked, line breaks and columns kept."""
    return re.sub(r'(?s)(?i:[rbuf]{0,2})("""|\'\'\').*?(?:\1|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|\'(?:\\.|[^\'\\\n])*(?:\'|(?=\n)|\Z)|#[^\n]*', _blank, text)


def mask_rust(text: str) -> str:
    """The same for Rust: line comments, nested block comments, plain and raw strings, characters."""
    out, i, n = [], 0, len(text)
    token = re.compile(r'//[^\n]*|/\*|r(#*)"|"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\.|[^\'\\\n])\'', re.S)
    while i < n:
        m = token.search(text, i)
        if not m:
            out.append(text[i:])
            break
        out.append(text[i : m.start()])
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and end < n:
                nxt = re.compile(r"/\*|\*/").search(text, end)
                if not nxt:
                    end = n
                    break
                depth += 1 if nxt[0] == "/*" else -1
                end = nxt.end()
        elif m[0].startswith("r") and m[0].endswith('"'):
            stop = text.find('"' + m[1], end)
            end = n if stop < 0 else stop + 1 + len(m[1])
        out.append(re.sub(r"[^\n]", " ", text[m.start() : end]))
        i = end
    return "".join(out)


def mask_script(text: str) -> str:
    """The same for JavaScript and TypeScript: comments, strings and templates."""
    return re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)", _blank, text, flags=re.S)


@F.pandas_udf(T.StringType())
def masked(text: pd.Series, language: pd.Series) -> pd.Series:
    """Source texts with strings and comments blanked; language python, rust, or else script. Null stays null."""
    mask = {"python": mask_python, "rust": mask_rust}
    return pd.Series([None if t is None else mask.get(g, mask_script)(t) for t, g in zip(text, language)])


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])
