"""Text expressions of the indexing and search tools."""

from pyspark.sql import functions as F

SYMBOL_BODY = 1000
COMMIT_TEXT = 6000
# Patterns for lines that begin a new part of a source file.
BOUNDARIES = [
    r"(export\s+)?(async\s+)?function\s+\w+",
    r"(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(",
    r"(export\s+)?class\s+\w+",
    r"(export\s+)?interface\s+\w+",
    r"(export\s+)?type\s+\w+",
    r"(export\s+)?enum\s+\w+",
    r"(pub\s+)?(async\s+)?fn\s+\w+",
    r"(pub\s+)?struct\s+\w+",
    r"(pub\s+)?impl\s+",
    r"(pub\s+)?trait\s+\w+",
    r"(pub\s+)?enum\s+\w+",
    r"(pub\s+)?mod\s+\w+",
    r"contract\s+\w+",
    r"(public|private|internal|external)?\s*(function|modifier|event)\s+\w+",
    r"(static\s+)?(inline\s+)?[\w\*]+\s+\w+\s*\(",
    r"(typedef\s+)?struct\s+\w*",
]
BOUNDARY = "^(?:" + "|".join(BOUNDARIES) + ")"


def strip(col):
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def project_name(col):
    """Lower case; other than letters, digits and hyphens become one hyphen; none at the ends."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9-]", "-"), "-+", "-")
    return F.regexp_replace(clean, "^-|-$", "")


def graph_name(project):
    return F.concat(F.lit("code_graph_"), project)


def symbol_text(name, signature, body, limit: int = SYMBOL_BODY):
    """Text to embed for a symbol: name, signature and a bounded body."""
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)
    return F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(signature, F.lit("")), F.coalesce(cut, F.lit("")))


def chunk_text(path, index, total, start, end, content):
    """Text to embed for a chunk of a file, with its place."""
    return F.concat(
        F.lit("File: "), path, F.lit("\nChunk: "), (index + 1).cast("string"), F.lit(" of "), total.cast("string"),
        F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n---\n"), content,
    )


def changed_files(col):
    """The names in a JSON array text; null for anything else."""
    return F.from_json(col, "array<string>")


def commit_text(message, files, diff, limit: int = COMMIT_TEXT):
    """Text to embed for a commit: message and files first, the diff as far as it fits."""
    names = F.coalesce(F.array_join(changed_files(files), "\n"), files, F.lit(""))
    header = F.concat(F.coalesce(message, F.lit("")), F.lit("\n\nFiles changed:\n"), names)
    joint = "\n\nDiff:\n"
    room = F.lit(limit - len(joint)) - F.length(header)
    diff = F.coalesce(diff, F.lit(""))
    cut = F.when(F.length(diff) > room, F.concat(diff.substr(F.lit(1), room), F.lit("..."))).otherwise(diff)
    return (
        F.when(F.length(header) >= limit, F.concat(F.substring(header, 1, limit), F.lit("...")))
        .when(room <= 0, header)
        .otherwise(F.concat(header, F.lit(joint), cut))
    )


def is_boundary(line):
    """Whether a source line begins a new part of a file."""
    return F.coalesce(strip(line).rlike(BOUNDARY), F.lit(False))


def without_binary(diff):
    """A diff without its lines on binary files."""
    return F.array_join(F.filter(F.split(diff, "\n", -1), lambda x: ~x.startswith("Binary files")), "\n")


def iso_time(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def score_text(score):
    return F.format_string("%.4f", score)
