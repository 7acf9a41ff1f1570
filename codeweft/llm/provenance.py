"""Files that no one wrote by hand: generated, minified, vendored, or data.

Measures of each file, from its tokens outside comments and strings:

- *surprise*: bits a character of its identifiers under a trigram model of the
  identifiers of its language.  It is compared with all files of the language:
  ``mangled`` is how many robust deviations (median, median deviation) it lies
  above them, the deviation being wider for files of few names.  A file of dense
  lines is minified if that is at least ``MANGLED`` under the model that explains
  its names best, and its names either hold at most half the bits of a usual
  name or are out of all proportion (``SCRAMBLED``).
- *diversity*: distinct shapes of its lines (names, numbers and strings blanked)
  and distinct names (numbers blanked) in proportion to their number.  Output of
  a template repeats few of either.
- *literal share*: how much of the text is numbers and strings.
- *foreign style*: how far the way its names are written (case, underscores,
  marks) lies from that of the other files of its project and language, as
  Jensen-Shannon divergence in bits.
- *foreign statements*: normalised lines that also occur, in a file of the same
  stem, in other projects.  A share of ``SHARED`` makes a file a copy, a share of
  ``SHARED_FOREIGN`` if its style is foreign as well.

A banner in the opening or closing comments and a third-party directory are
evidence too; words that only mention such things, elsewhere or otherwise, are
not.

The model is counted over all files, in buckets of fixed number; norms and styles
are aggregations by language and project.  Foreign statements are two aggregations
by statement, combined before the shuffle; no file is compared with another.

Null contents are no cases; repeated rows of (project, file_path) count once; a
null project is a project of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import ngrams
from codeweft.storage import materialize, spread

LANGUAGES = ["ts", "tsx", "js", "jsx", "rs", "sol", "c", "h"]
STATEMENT = 30
MANGLED, SCRAMBLED, DENSE = 3.0, 8.0, 300
#: names of a file that count as much as what its language's spread says; least spread in bits
FEW_NAMES, LEAST_SPREAD = 20, 0.02
SHARED, SHARED_FOREIGN, FOREIGN_STYLE = 0.6, 0.3, 0.2

_skipped = re.compile(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""", re.S
)
_number = re.compile(r"\b\d[\w.]*")
_name = re.compile(r"[A-Za-z_$][\w$]*")
_space = re.compile("[ \t\r\f\ufeff]+")
#: a row of numbers or strings has one shape, whatever its length
_run = re.compile(r"(?:-?0,)+")
_control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\ufffd]")
_keywords = frozenset(
    """import from export default function async await return const let var if else for while do switch case break continue new
    class extends implements interface type enum public private protected static readonly struct fn pub use impl trait mod match mut
    self contract event modifier mapping address require emit returns view pure external internal memory storage string uint256 bytes32
    bool int char long short unsigned float double void typedef include define ifdef endif pragma solidity sizeof throw try catch
    finally number boolean null true false this undefined as in of where dyn ref move unsafe extern crate usize i32 u64 f64 u8 u32
    String Option Some None Ok Err""".split()
)
_comment = re.compile(r"/\*(.*?)(?:\*/|$)|//([^\n]*)", re.S)
_numbered = re.compile(r"[A-Za-z_]\d+(?:_|$)")
#: how names are written; the first that fits counts
STYLES = {
    "marked": re.compile(r"^[_$]|^[a-z]{1,3}_[A-Z]|^[bcfgkmnps][A-Z][a-z].*[a-z]$(?<=^.{9})"),
    "upper": re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^[A-Z][A-Z0-9]+$"),
    "snake": re.compile(r"^[a-z].*_"), "mixed": re.compile(r"_"), "camel": re.compile(r"^[a-z].*[A-Z]"), "pascal": re.compile(r"^[A-Z].*[a-z]"), "plain": re.compile(""),
}
#: what may stand around the opening comments: marks, include guards, pragmas, inner attributes
_header = re.compile(
    r"""(?:[\s\ufeff]+|/\*.*?\*/|//[^\n]*|\#[ \t]*(?:if|ifdef|ifndef|include|pragma|undef)\b[^\n]*|\#[ \t]*define[ \t]+\w+[ \t]*(?=\n|\Z)|\#![^\n]*|pragma\ [^\n;]*;|["']use\ strict["'];?)*+""",
    re.S | re.X,
)
# How tools and copies announce themselves in an opening or closing comment.
GENERATED = re.compile(
    r"(?i)\b(?:code|file|source|this (?:file|code) (?:was|is|has been)) (?:auto(?:matically)?[- ]?)?(?:generated|created) (?:automatically )?(?:by|from)\b|^\W*@generated\b"
    r"|<auto-generated|\bauto-?generated (?:file|code|by|from)|\bautomatically (?:generated|created) by|^\W*generated (?:by|from|with|using)\b"
    r"|^\W*output of \w+|\bmachine[- ](?:written|generated) by|\bedits (?:are|will be) (?:over-?written|lost)|\bchanges will be lost|\bdo not (?:edit|modify)\b\W*(?:$|regenerate|by hand|manually|this file|;)|\b(?:never|don't) (?:change|edit) by hand"
)
THIRD_PARTY = re.compile(
    r"(?i)^\W*(?:copied|vendored|imported|adapted|taken) from \S+ v?\d[\w.-]*|\bupstream: *https?://|^\W*copyright (?:\(c\) )?(?:\d{4}[-, ]*)*the \S+ (?:authors|contributors|developers)"
    r"|\(c\) (?:\d{4}[-, ]*)*(?:the )?\S+ (?:authors|contributors|developers)|^\W*\S+ v\d+\.\d+[\w.-]* *$|\bredistribution and use in source (?:form|and binary)"
)
DIRECTORY = re.compile(r"(?:^|/)(?:vendor|vendors|third[_-]party|3rdparty|external|extern|deps|node_modules|bower_components)/[^/]+/|^(?:.*/)?lib/[^/]+/(?:src|dist)/")
MINIFIED_NAME = re.compile(r"[.-]min\.[a-z]+$")


def language(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path else ""


def stem(path: str) -> str:
    """File name without what a copy may add to it: extension and last part."""
    name = path.rsplit("/", 1)[-1].split(".", 1)[0]
    return name.rsplit("_", 1)[0] if "_" in name else name


def banners(text: str, end: int) -> list[str]:
    """Lines of the whole opening and closing comments, and of those near the top.

    ``end`` is where the last line of code ends; a comment on that line is a
    remark on it.  A comment that starts in the first eight lines counts
    wherever it stands.
    """
    head = _header.match(text).end()
    top = len("\n".join(text.split("\n", 8)[:8]))
    found = list(_comment.finditer(text, 0, head)) + list(_comment.finditer(text, max(head, end)))
    if head < top:
        found += [_comment.match(text, m.start()) for m in _comment.finditer(text, head, top)]
    return [x for m in found for x in (m[1] or m[2] or "").split("\n")]


def measure(text: str) -> dict:
    """What can be measured in one file without the model."""
    literal = 0

    def blank(m):
        # same length: \x01 stands for nothing, \x02 for a string
        nonlocal literal
        n = m.end() - m.start()
        if m["comment"]:
            return "\x01" * n
        literal += n
        return "\x02" + "\x01" * (n - 1)

    code = _skipped.sub(blank, text)
    end = len(code)
    while end > 0:
        start = code.rfind("\n", 0, end) + 1
        line = code[start:end].strip(" \t\r\f\ufeff\x01")
        if line and not re.match(r"#\s*endif", line):
            break
        end = start - 1
    end = max(0, end)
    code = code.replace("\x01", "")
    size = len(re.sub(r"\s", "", code)) + literal - code.count("\x02")
    literal += sum(map(len, _number.findall(code)))
    code = _number.sub("0", code)
    names = Counter(_name.findall(code))
    for k in _keywords & names.keys():
        del names[k]
    shape = _space.sub("", _name.sub(lambda m: m[0] if m[0] in _keywords else "x", code)).replace("\x02", "0")
    shapes = Counter(_run.sub("0,", x) for x in shape.split("\n") if x)
    lines, uses = sum(shapes.values()), sum(names.values())
    return {
        "names": names,
        "size": size,
        "end": end,
        "lines": lines,
        "longest": max(map(len, text.split("\n"))),
        "literal": literal / max(1, size),
        "shapes": len(shapes) / max(1, lines),
        "stems": len({re.sub(r"\d+", "#", n) for n in names}) / max(1, len(names)),
        "numbered": sum(c for n, c in names.items() if len(n) > 2 and _numbered.search(n)) / max(1, uses),
        "uses": uses,
    }


def surprise(counts: np.ndarray, names: Counter, salt: int) -> tuple[float, float]:
    """Bits a character (its end included) and bits a name of the identifiers of a file, averaged over their uses."""
    if not names:
        return 0.0, 0.0
    texts = list(names)
    n = np.array([names[t] for t in texts], dtype=float)
    lengths = np.array([len(t) + 1 for t in texts])
    bits = -ngrams.logs(counts, texts, salt) / math.log(2) * n
    return float((bits / lengths).sum() / n.sum()), float(bits.sum() / n.sum())


def style(names) -> list[float]:
    """Distinct names by how they are written, in the order of ``STYLES``."""
    out = [0.0] * len(STYLES)
    for n in names:
        for i, pattern in enumerate(STYLES.values()):
            if pattern.search(n):
                out[i] += 1
                break
    return out


def announced(path: str, text: str, end: int) -> tuple[bool, bool]:
    """Whether the file says that it was generated, and that it is a copy."""
    head = banners(text, end)
    return (
        any(GENERATED.search(x.strip(" *")) for x in head),
        any(THIRD_PARTY.search(x.strip(" *!")) for x in head) or bool(DIRECTORY.search(path)),
    )


def statements(text: str) -> set[str]:
    """Normalised lines with names in them, long enough to be telling."""
    out = set()
    for line in text.split("\n"):
        line = " ".join(line.split())
        if len(line) >= STATEMENT and not line.startswith(("import ", "use ", "#include", "//", "*", "/*", "pragma ")) and line.count(" ") >= 2:
            out.add(line)
    return out


def identifier_counts(files: DataFrame) -> np.ndarray:
    """Trigram counts of the identifiers of each language, each file's names once."""

    def count(batches):
        sums = np.zeros(ngrams.BUCKETS + 1)
        for batch in batches:
            names = {}
            for path, text in zip(batch["file_path"], batch["content"]):
                found = {w for w in re.findall(r"[A-Za-z_$][\w$]*", text) if w not in _keywords}
                names.setdefault(language(path), Counter()).update(found)
            for lang, c in names.items():
                ngrams.add(sums, c, LANGUAGES.index(lang) + 1 if lang in LANGUAGES else 0)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": sums[at]})

    total = files.mapInPandas(count, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ngrams.BUCKETS + 1)
    counts[total["slot"].to_numpy()] = total["n"].to_numpy()
    return counts


def _salt(lang: str) -> int:
    return LANGUAGES.index(lang) + 1 if lang in LANGUAGES else 0


def measured(files: DataFrame, counts) -> DataFrame:
    """One row of measures for each file; ``names`` only where its lines are dense."""
    columns = ["uses", "longest", "size", "lines", "literal", "shapes", "stems", "numbered"]
    types = "uses int, longest int, size int, lines int, literal double, shapes double, stems double, numbered double"

    def run(batches):
        for batch in batches:
            out = []
            for project, path, text in zip(batch["project"], batch["file_path"], batch["content"]):
                m, lang = measure(text), language(path)
                lang = lang if lang in LANGUAGES else ""
                short = bool(MINIFIED_NAME.search(path))
                dense = short or m["longest"] >= DENSE
                names = [{"name": n, "n": c} for n, c in m["names"].items()] if dense else None
                out.append((
                    project, path, lang, *(m[c] for c in columns), *surprise(counts.value, m["names"], _salt(lang)),
                    *announced(path, text, m["end"]), not _control.search(text), style(m["names"]), names,
                ))
            yield pd.DataFrame(out, columns=["project", "file_path", "language", *columns, "surprise", "name_bits", "marked", "third", "text", "style", "names"])

    return files.mapInPandas(
        run, f"project string, file_path string, language string, {types}, surprise double, name_bits double,"
        " marked boolean, third boolean, text boolean, style array<double>, names array<struct<name: string, n: int>>",
    ).dropDuplicates(["project", "file_path"])


def norms(rows: DataFrame) -> DataFrame:
    """(language, usual, spread, usual_name) of the surprise of its files; a row for each language."""
    rows = rows.where("uses > 0 and text")
    middle = rows.groupBy("language").agg(F.percentile_approx("surprise", 0.5).alias("usual"), F.percentile_approx("name_bits", 0.5).alias("usual_name"))
    off = rows.join(F.broadcast(middle), "language").groupBy("language").agg(
        F.first("usual").alias("usual"), F.first("usual_name").alias("usual_name"), F.percentile_approx(F.abs(F.col("surprise") - F.col("usual")), 0.5).alias("off")
    )
    return off.select("language", "usual", (1.4826 * F.greatest("off", F.lit(LEAST_SPREAD))).alias("spread"), "usual_name")


def mangled_files(rows: DataFrame, norm: list, counts) -> DataFrame:
    """(project, file_path, mangled) of the dense files with mangled names; see the module text."""
    known = {r.language: r for r in norm}

    def run(batches):
        for batch in batches:
            out = []
            for project, path, lang, found in zip(*(batch[c] for c in ("project", "file_path", "language", "names"))):
                names = Counter({x["name"]: x["n"] for x in found})
                few = math.sqrt(1 + FEW_NAMES / max(1, sum(names.values())))
                score = []
                for r in known.values():
                    bits, name_bits = surprise(counts.value, names, _salt(r.language))
                    score.append(((bits - r.usual) / (r.spread * few), name_bits <= r.usual_name / 2))
                least, small = min(score, default=(0.0, False))
                if least >= (MANGLED if small else SCRAMBLED):
                    out.append((project, path, least))
            yield pd.DataFrame(out, columns=["project", "file_path", "mangled"])

    return rows.select("project", "file_path", "language", "names").mapInPandas(run, "project string, file_path string, mangled double")


def divergence(own, other):
    """Jensen-Shannon divergence in bits of two arrays of counts (the second smoothed)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    a = F.transform(own, lambda x: x / total(own))
    smooth = F.transform(other, lambda x: x + 0.5)
    b = F.transform(smooth, lambda x: x / total(smooth))
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return total(F.zip_with(a, b, lambda x, y: (term(x, y) + term(y, x)) / 2))


def foreign_styles(rows: DataFrame) -> DataFrame:
    """(project, file_path, foreign_style): 0 where the project has fewer names besides than the file itself."""
    named = rows.where("uses > 0 and text").select("project", "file_path", "language", "style")
    sums = [F.sum(F.element_at("style", i + 1)).alias(f"s{i}") for i in range(len(STYLES))]
    whole = named.groupBy("project", "language").agg(*sums).select(
        F.col("project").alias("p"), F.col("language").alias("l"), F.array(*[f"s{i}" for i in range(len(STYLES))]).alias("whole")
    )
    joined = named.join(whole, named["project"].eqNullSafe(whole["p"]) & (named["language"] == whole["l"]))
    rest = joined.withColumn("rest", F.zip_with("whole", "style", lambda x, y: x - y))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    enough = total(F.col("rest")) >= total(F.col("style"))
    return rest.select("project", "file_path", F.when(enough, divergence(F.col("style"), F.col("rest"))).otherwise(0.0).alias("foreign_style"))


def foreign_statements(files: DataFrame) -> DataFrame:
    """(project, file_path, statements, foreign): statements and the share that files of the same stem of other projects hold."""

    def cut(batches):
        for batch in batches:
            out = [
                (project, path, stem(path), line)
                for project, path, text in zip(batch["project"], batch["file_path"], batch["content"])
                for line in statements(text)
            ]
            yield pd.DataFrame(out, columns=["project", "file_path", "stem", "line"])

    lines = files.mapInPandas(cut, "project string, file_path string, stem string, line string").select(
        "project", "file_path", F.xxhash64("stem", "line").alias("statement")
    ).distinct()
    # two projects have a statement if the least and the greatest name differ
    named = lines.withColumn("p", F.coalesce("project", F.lit("")))
    known = named.groupBy("statement").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("statement", F.lit(1).alias("hit"))
    return (
        lines.join(known, "statement", "left").groupBy("project", "file_path")
        .agg(F.count("*").alias("statements"), F.sum("hit").alias("hits"))
        .select("project", "file_path", "statements", (F.coalesce("hits", F.lit(0)) / F.col("statements")).alias("foreign"))
    )


def provenance(files: DataFrame, least: int = 3) -> DataFrame:
    """(project, file_path, kind, score, surprise, mangled, diversity, literal_share, foreign_style, foreign) of every file.

    ``kind`` is null for hand-written files.  A copy needs at least ``least`` statements.
    """
    spark = files.sparkSession
    files = files.select("project", "file_path", "content").where("content is not null and file_path is not null")
    counts = spark.sparkContext.broadcast(identifier_counts(files))
    rows = materialize(measured(spread(files), counts))
    norm = norms(rows).collect()  # a row for each language
    mangled = mangled_files(rows.where("names is not null and text"), norm, counts)
    out = rows
    for part in (mangled, foreign_styles(rows), foreign_statements(files)):
        part = part.withColumnsRenamed({"project": "p", "file_path": "f"})
        out = out.join(part, out["project"].eqNullSafe(part["p"]) & (out["file_path"] == part["f"]), "left").drop("p", "f")
    data = "size >= 400 and literal >= 0.4 and (shapes <= 0.1 or uses <= 0.02 * size)"
    template = "lines >= 12 and (shapes <= 0.3 and (numbered >= 0.1 or stems <= 0.93) or shapes <= 0.4 and numbered >= 0.25)"
    copy = f"statements >= {least} and (foreign >= {SHARED} or foreign >= {SHARED_FOREIGN} and foreign_style >= {FOREIGN_STYLE})"
    kind = (
        F.when(~F.col("text"), None).when(F.expr(data), "data").when(F.col("mangled").isNotNull(), "minified")
        .when(F.expr(f"marked or {template}"), "generated").when(F.expr(f"third or ({copy})"), "vendored")
    )
    score = (
        F.when(kind == "minified", F.col("mangled")).when(kind == "data", F.col("literal"))
        .when(kind == "generated", F.when(F.col("marked"), 1.0).otherwise(1 - F.col("shapes"))).when(kind == "vendored", F.when(F.col("third"), 1.0).otherwise(F.col("foreign")))
    )
    return out.select(
        "project", "file_path", kind.alias("kind"), F.coalesce(score, F.lit(0.0)).alias("score"), "surprise", "mangled", F.col("shapes").alias("diversity"),
        F.col("literal").alias("literal_share"), F.coalesce("foreign_style", F.lit(0.0)).alias("foreign_style"), F.coalesce("foreign", F.lit(0.0)).alias("foreign"),
    )
