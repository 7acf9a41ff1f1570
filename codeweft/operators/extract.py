"""Symbols and relationships of source files, by declaration patterns.

Comments and the contents of strings are blanked first, so that patterns and
brackets only meet code.  A declaration reaches to its closing brace (or
semicolon); what lies in a class, impl or contract is named ``Owner.name``.
Extraction is per file and adds no shuffle; resolving the relationships to
vertices is the join of :mod:`codeweft.operators.graph`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The language of each extension, and type names that are no use of a type.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "rs": "rust", "sol": "solidity", "c": "c", "h": "c"}
BUILTIN_TYPES = {
    "typescript": ["string", "number", "boolean", "void", "any", "never", "unknown", "null", "undefined"],
    "rust": ["i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char", "str", "String", "Self"],
}
_comment = r"//[^\n]*|/\*.*?\*/"
_blank = {
    "typescript": re.compile(_comment + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?<=[=(:,!&|?;] )/(?![/*])(?:[^/\\\n\[]|\\.|\[[^\]\n]*\])+/|(?P<sign>[`{}])", re.S),
    "solidity": re.compile(_comment + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "c": re.compile(_comment + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "rust": re.compile(r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*\*/|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S),
}
_word = r"[A-Za-z_$][\w$]*"
#: kind, pattern, whether what it declares owns what lies in it
_declarations = {
    "typescript": [
        ("import", re.compile(r"^[ \t]*import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?", re.M), False),
        ("class", re.compile(rf"\bclass\s+({_word})(?:\s*<[^{{>]*>)?(?:\s+extends\s+([\w$]+))?[^{{;]*(?=\{{)"), True),
        ("interface", re.compile(rf"\binterface\s+({_word})[^{{;]*(?=\{{)"), False),
        ("type", re.compile(rf"\btype\s+({_word})\s*(?:<[^=;]*>)?\s*="), False),
        ("function", re.compile(rf"\b(?:async\s+)?function\s*\*?\s*({_word})\s*(?:<[^>(]*>)?(?=\()"), False),
        ("function", re.compile(rf"\b(?:const|let|var)\s+({_word})\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?=(?:\([^()]*\)|{_word})\s*(?::[^=;{{]+)?=>)"), False),
        ("method", re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|override|get|set)\s+)*({_word})\s*(?:<[^>(]*>)?(?=\([^;{{}}]*\)\s*(?::[^;{{}}]+)?\{{)", re.M), False),
    ],
    "rust": [
        ("import", re.compile(r"\buse\s+([^;]+);"), False),
        ("module", re.compile(r"\bmod\s+(\w+)\s*(?=\{)"), False),
        ("struct", re.compile(r"\bstruct\s+(\w+)"), False),
        ("enum", re.compile(r"\benum\s+(\w+)"), False),
        ("trait", re.compile(r"\btrait\s+(\w+)"), False),
        ("impl", re.compile(r"\bimpl\b(?:\s*<[^>{]*>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?([\w:]+)[^{;]*(?=\{)"), True),
        ("function", re.compile(r"\bfn\s+(\w+)\s*(?:<[^(]*>)?(?=\()"), False),
    ],
    "solidity": [
        ("import", re.compile(r"\bimport\b[^;]*;"), False),
        ("contract", re.compile(r"\bcontract\s+(\w+)(?:\s+is\s+([^{]+?))?\s*(?=\{)"), True),
        ("interface", re.compile(r"\binterface\s+(\w+)[^{]*(?=\{)"), True),
        ("function", re.compile(r"\bfunction\s+(\w+)\s*(?=\()"), False),
        ("event", re.compile(r"\bevent\s+(\w+)\s*(?=\()"), False),
        ("modifier", re.compile(r"\bmodifier\s+(\w+)"), False),
        ("struct", re.compile(r"\bstruct\s+(\w+)\s*(?=\{)"), False),
        ("enum", re.compile(r"\benum\s+(\w+)\s*(?=\{)"), False),
    ],
    "c": [
        ("import", re.compile(r"^[ \t]*#[ \t]*include[ \t]*[^\n]+", re.M), False),
        ("type", re.compile(r"\btypedef\b[^;{]*(?:\{[^}]*\})?[^;]*?\b(\w+)\s*(?:\[[^\]]*\]\s*)?;"), False),
        ("struct", re.compile(r"(?<!typedef )\bstruct\s+(\w+)\s*(?=\{)"), False),
        ("enum", re.compile(r"(?<!typedef )\benum\s+(\w+)\s*(?=\{)"), False),
        ("function", re.compile(r"^[A-Za-z_][\w \t]*?[\w\*][ \t\*]+(\w+)\s*(?=\([^;{}()]*\)\s*[{;])", re.M), False),
    ],
}
_not_names = frozenset("if for while switch catch return function else do new typeof await sizeof match loop in of case throw super constructor import using emit revert require assert".split()) - {"constructor", "super", "require", "assert"}
_call = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)\s*\(")
_type = {"typescript": re.compile(r"(?:[:<|&,]|\bas\b)\s*([A-Z][\w$]*)"), "rust": re.compile(r"(?:[:<&,>]|\bfor\b)\s*(?:'\w+\s+)?(?:mut\s+)?([A-Z]\w*)")}


_template = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|$)", re.S)


def _blanked(text: str, pattern):
    """``text`` in pieces, with comments, strings and literal parts of templates blanked."""
    at, i, open_ = 0, 0, []
    hide = lambda a, b: re.sub(r"[^\n]", " ", text[a:b])
    while m := pattern.search(text, i):
        sign = m.groupdict().get("sign")
        start, i = m.start(), m.end()
        if sign == "{":
            open_.append("{")
            continue
        if sign == "}" and (not open_ or open_.pop() == "{"):
            continue
        if sign:  # a template begins, or goes on after an expression
            part = _template.match(text, i)
            i = part.end()
            if part[1] == "${":
                open_.append("$")
        yield text[at:start]
        yield hide(start, i)
        at = i
    yield text[at:]


class Source:
    """A source text with its blanked form, lines and matching braces."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.code = "".join(_blanked(text, _blank[language]))
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close, stack = {}, []
        for m in re.finditer(r"[{}]", self.code):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.end()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def end(self, at: int) -> int:
        """Where a declaration whose head ends at ``at`` is over."""
        depth = 0
        for m in re.compile(r"[(){};]").finditer(self.code, at):
            c = m.group()
            depth += (c == "(") - (c == ")")
            if depth <= 0 and c == ";":
                return m.end()
            if depth <= 0 and c == "{":
                return self.close.get(m.start(), len(self.code))
        return len(self.code)


def extract(path: str, text: str):
    """(nodes, relationships) of one file, as tuples in the order of the tables."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1])
    if language is None:
        return [], []
    s = Source(text, language)
    found, owners = [], []
    for kind, pattern, owns in _declarations[language]:
        for m in pattern.finditer(s.code):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if kind == "import":
                found.append((kind, start, m.end(), m))
                continue
            name = (f"impl {m[1]} for {m[2]}" if m[1] else f"impl {m[2]}") if kind == "impl" else m[1]
            if name in _not_names and language != "rust":
                continue
            end = m.end() if kind == "type" and language == "c" else s.end(m.end())
            if owns:
                owners.append((start, end, m[2] if kind == "impl" else name))
            found.append((kind, start, end, m))
    nodes, rels = [], []
    taken = set()
    for kind, start, end, m in sorted(found, key=lambda x: (x[1], -x[2])):
        owner = next((o for a, b, o in owners if a < start and end <= b), None)
        body = text[start:end]
        if kind == "import":
            quoted = re.search(r"['\"]([^'\"]+)['\"]|<([^>]+)>", body)
            if language == "rust":
                module = re.sub(r"^crate::|::(?:\{.*|\*|\w+)$", "", m[1].strip(), flags=re.S) if "::" in m[1] else m[1].strip()
            elif quoted:
                module = quoted[1] or quoted[2]
            else:
                continue
            nodes.append((module, "import", body.strip(), s.line(start), s.line(max(start, end - 1)), body.strip()))
            named = re.search(r"\{([^}]*)\}", body) if language == "typescript" else None
            targets = [x.split(" as ")[0].strip() for x in named[1].split(",")] if named else ([] if language == "typescript" else [module])
            rels += [(path, "import", t, "function", "IMPORTS") for t in targets if t]
            continue
        name = f"impl {m[1]} for {m[2]}" if kind == "impl" and m[1] else f"impl {m[2]}" if kind == "impl" else m[1]
        if kind == "method":
            if owner is None:
                continue
            kind = "function"
        elif owner is not None and kind == "class":
            owner = None
        if (kind, start) in taken or any(k == kind and a == m.start(1) for k, a in taken if kind == "function"):
            continue
        taken |= {(kind, start), (kind, m.start(1) if m.lastindex else start)}
        if owner is not None and kind not in ("impl", "contract", "interface", "trait", "module") and language != "c":
            name = f"{owner}.{name}"
        head = re.sub(r"\s+", " ", s.text[start : s.code.find("{", start, end) if "{" in s.code[start:end] else end]).strip().rstrip(";").strip()
        head = head if kind in ("function", "contract", "event", "impl") else f"{kind} {name.rsplit('.', 1)[-1]}"
        nodes.append((name, kind, head, s.line(start), s.line(max(start, end - 1)), body))
        if kind in ("class", "contract") and m[2]:
            rels += [(name, kind, p.split("(")[0].strip(), kind, "EXTENDS") for p in m[2].split(",") if p.strip()]
        if kind == "impl" and m[1]:
            rels.append((m[2], "struct", m[1], "trait", "IMPLEMENTS"))
        if kind == "function":
            code = s.code[m.end() : end]
            opening = code.find("{")
            if opening >= 0:
                calls = dict.fromkeys(c[1] for c in _call.finditer(code, opening) if c[1].split(".")[0] not in _not_names and c[1] not in _not_names)
                rels += [(name, "function", c, "function", "CALLS") for c in calls]
            if language in _type and not (language == "typescript" and owner):
                types = dict.fromkeys(t[1] for t in _type[language].finditer(code if language == "typescript" else s.code[m.start() : end]))
                rels += [(name, "function", t, "type", "USES") for t in types if t not in BUILTIN_TYPES[language]]
    return nodes, rels


def symbols(files: DataFrame) -> DataFrame:
    """(project, file_path, name, kind, signature, start_line, end_line, body) of all files.

    Files of unknown extensions and null contents have none; repeated rows of a
    file count once.
    """

    def run(batches):
        for batch in batches:
            out = [(p, f, *n) for p, f, t in zip(batch["project"], batch["file_path"], batch["content"]) for n in extract(f, t)[0]]
            yield pd.DataFrame(out, columns=["project", "file_path", "name", "kind", "signature", "start_line", "end_line", "body"])

    return _sources(files).mapInPandas(run, "project string, file_path string, name string, kind string, signature string, start_line int, end_line int, body string")


def relationships(files: DataFrame) -> DataFrame:
    """The unresolved relationships of all files, in the form of raw_relationships."""

    def run(batches):
        for batch in batches:
            out = [(p, f, *r) for p, f, t in zip(batch["project"], batch["file_path"], batch["content"]) for r in extract(f, t)[1]]
            yield pd.DataFrame(out, columns=["project", "source_file_path", "source_name", "source_kind", "target_name", "target_kind", "relationship_kind"])

    return _sources(files).mapInPandas(
        run, "project string, source_file_path string, source_name string, source_kind string, target_name string, target_kind string, relationship_kind string"
    ).distinct()


def _sources(files: DataFrame) -> DataFrame:
    known = F.regexp_extract("file_path", r"\.(\w+)$", 1).isin(*LANGUAGES)
    return files.where(F.col("content").isNotNull() & known).select("project", "file_path", "content").dropDuplicates(["project", "file_path"])
