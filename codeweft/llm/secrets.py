"""Credentials embedded in source code: literals segmented into dictionary words.

A literal is split by Viterbi into words of the collection's own vocabulary and
unexplained characters; what stays unexplained is the *residual*.  A literal
becomes a credential when its residual is long enough for its context: little
is needed next to a name such as ``password`` or in a login form, much where
the context says nothing.  Known public formats (checksums, ids, addresses,
public keys, embedded images) are excluded, as are placeholders, references to
variables and names of secrets.

The dictionary is learned from all records: words are counted by record inside
the tasks, summed by Spark, and the ``DICTIONARY`` most frequent ones kept, which
bounds what is broadcast.  Each record is then scanned once, without a shuffle.

Null and empty texts hold nothing; repeated rows of a key count once.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY = 50_000
#: a word occurs in this share of the records, a short one in five times as many:
#: pieces of random literals repeat too, in proportion to the records
LEAST_SHARE, SHORT = 2e-4, 3
LONGEST_WORD = 24

_subword = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")

# Words that name credentials, and the prefixes of issued tokens.
SECRET_NAMES = {
    "password", "passwd", "pwd", "pass", "passphrase", "pw", "secret", "token", "credential", "credentials", "cred",
    "creds", "auth", "login", "mnemonic", "apikey", "bearer", "pk", "seedphrase",
}
KEY_OWNERS = {"api", "client", "access", "private", "secret", "signing", "encryption", "auth", "wallet", "account", "master", "ssh"}
WORD_NAMES = {"password", "passwd", "pwd", "pass", "passphrase", "pw", "secret", "creds", "credentials", "login"}
PUBLIC_NAMES = {
    "digest", "integrity", "checksum", "hash", "sha", "uuid", "guid", "icon", "image", "verifier", "public", "commit",
    "fingerprint", "etag", "address", "variable", "url", "name", "file", "path", "env", "label", "count", "policy", "length", "hint",
}
TOKEN = re.compile(
    r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abprs]-[A-Za-z0-9-]{16,}"
    r"|[sr]k_(?:live|prod)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|glpat-[\w-]{18,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|ya29\.[\w-]{20,}|dop_v1_[a-f0-9]{40,}|pypi-[\w-]{20,}|[a-z]{2,8}_(?:live|prod|secret|key|tok)_[A-Za-z0-9]{20,}"
    r"|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{16,})"
)
TOKEN_LIKE = re.compile(r"^[\w.-]{20,100}$")
PLACEHOLDER = re.compile(
    r"(?i)^(?:\W*|x{3,}|\*{3,}|\.{3,}|0+|(?:your|my|the|some|an?|insert|enter|put|add)[ _-].*|change[ _-]?(?:me|it|this).*|replace[ _-]?.*|example.*"
    r"|placeholder.*|dummy.*|todo.*|none|null|undefined|true|false|redacted.*|\[?(?:redacted|hidden|masked|removed)\]?|<.*>|\$\{.*\}|\{\{.*\}\}|\{.*\}"
    r"|\$\(.*\)|\$\w+|%\w+%|%s|@\w+@|process\.env.*|os\.environ.*|env[.:(].*|vault:.*|secretref:.*|ref\+.*|!ref.*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)$"
)
PUBLIC = re.compile(
    r"^(?:sha(?:1|256|384|512)-.*|sha256:.*|md5:.*|data:.*|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|ssh-(?:rsa|ed25519) .*|-----BEGIN (?:PUBLIC KEY|CERTIFICATE).*)",
    re.S,
)
#: letters with a sign that names and numbers don't have, and a number
MIXED = re.compile(r"^(?=.*[A-Za-z]{3})(?=.*\d\d)[A-Za-z0-9]*[!#%&*+?@^~][A-Za-z0-9]*$")
HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
#: an assignment operator, at most one opening call, a literal and what is joined to it
ASSIGNED = re.compile(
    r"""(?:=>|:=|=|:|\|\||\?\?)[ \t]*(?P<call>(?:[A-Za-z_$][\w.:$]*!?\([ \t]*)?)(?P<q>["'`])(?P<v>(?:[^"'`\\\n]|\\.|(?!(?P=q))["'`])*)(?P=q)"""
    r"""(?P<more>(?:[ \t]*[+,.]?[ \t]*\\?\n?[+-]?[ \t]*["'](?:\\.|[^"'\\\n])*["'])*)"""
)
#: the name before the operator, with its type or, before ``||``, what else it may be
NAMED = re.compile(
    r"""(?P<name>["']?[A-Za-z_$][\w$.-]*["']?(?:\[\d*\])?)[ \t]*"""
    r"""(?::[ \t]*&?(?:'static[ \t]+)?[\w<>\[\]]+[ \t]*|=[ \t]*[\w.$]+(?:\[["']\w+["']\])?[ \t]*)?$"""
)
PLAIN = re.compile(r"^[a-z]*(?:[ _-][a-z]+)*$")
CALLED = re.compile(r"""\((?P<args>[^()\n"']*["'][^()\n]*)\)""")
ENCODER = re.compile(r"(?i)atob|base64")
CALLEE = re.compile(r"[A-Za-z_$][\w.$]*!?$")
ARGUMENT = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
UNQUOTED = re.compile(r"^[+\- \t]*(?:export[ \t]+|ENV[ \t]+|-[ \t]+|(?://|#)[ \t]*)?(?P<name>[A-Za-z][\w.-]*)[ \t]*[=:][ \t]*(?P<v>[^\s\"'`;,(){}\[\]<>]{6,})[ \t]*\r?$", re.M)
OPTION = re.compile(r"""(?P<name>[A-Za-z_][\w-]*)(?:=|:[ \t]*)(?P<q>\\?["'])?(?P<v>(?(q)[^"'`\\\n]+|[^;&\s"'`\\,]+))""")
#: the same where semicolons separate
LISTED = re.compile(r"""(?P<name>[A-Za-z_][\w-]*)=(?P<q>\\?["'])?(?P<v>[^;\s"'`\\]+)""")
#: what is taken where a variable of the environment isn't set
FALLBACK = re.compile(r"""["'](?P<name>[A-Z][A-Z0-9_]*)["'][ \t]*[\])]?[ \t]*(?:\.\w+\([ \t]*(?:\|\w*\|[ \t]*)?|\?\?|\|\|)[ \t]*["'](?P<v>[^"'\\\n]+)["']""")
USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]*://(?P<user>[^/\s:@\"'`]*):(?P<v>[^/\s@\"'`]+)@")
QUERY = re.compile(r"[?&](?P<name>[A-Za-z_-]+)=(?P<v>[^&\s\"'`#]+)")
HEADER = re.compile(r"(?i)\b(?:authorization[\"']?[ \t]*[:=,][ \t]*[\"']?)?\b(?P<kind>basic|bearer)[ \t]+(?P<v>[A-Za-z0-9+/=._~-]{8,})")
KEY_HEADER = re.compile(r"(?i)\bx-[a-z-]*(?:key|token|secret)[\"']?[ \t]*[:=,][ \t]*[\"']?(?P<v>[\w+/=.-]{8,})")
CURL_USER = re.compile(r"""(?:-u|--user)[ =]["']?(?P<user>[^\s:"']+):(?P<v>[^\s"']+)""")
PRIVATE = re.compile(r"-----BEGIN (?P<kind>[A-Z ]*)PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:\\n|[\s+A-Za-z0-9/=\"',-])*?)(?=-----END|$|[^\\\sA-Za-z0-9+/=\"',-])")
LOGIN_NOTE = re.compile(r"(?i)\b(?:login|creds?|credentials?|account|password|pass|pwd)\b[^\n]{0,24}?(?::|->|=|is)[ \t]*(?P<user>[\w.@-]+)[ \t]*(?:/|\|)[ \t]*(?P<v>[^\s,;\"'`]+)")
WALLET = re.compile(r"(?i)\b0x[0-9a-f]{64}\b")
NOTED = re.compile(r"(?i)\b(?:private key|wallet key|signing key|secret key|signer pk|pk|priv(?:ate)?key|mnemonic|seed)\b[^\n]{0,40}$")
FORM = re.compile(r"(?i)\b(?:password|passwd|secret|token|api_?key)=(?P<v>[^&\s\"'`;,)}]{6,})")

#: a name with the context "secret" holds one of these; none holds another
NAME_PARTS = [p for p in sorted(SECRET_NAMES | {"key"}) if not any(q in p for q in (SECRET_NAMES | {"key"}) - {p})]


class Words:
    """Viterbi segmentation by a dictionary."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.cache: dict[str, int] = {}

    def residual(self, text: str) -> int:
        """Letters and digits of ``text`` that no word of the dictionary explains.

        The cheapest split is kept: a word costs its log rarity, an unexplained
        character 6.  A word is written in lower case, capitalised or in capitals.
        """
        known = self.cache.get(text)
        if known is not None:
            return known
        n = len(text)
        best, rest = [0.0] + [1e18] * n, [0] * (n + 1)
        for i in range(n):
            c = text[i]
            plain = not c.isalnum()
            cost, left = best[i] + (0.5 if plain else 6.0), rest[i] + (not plain)
            if cost < best[i + 1]:
                best[i + 1], rest[i + 1] = cost, left
            if c.isalpha():
                for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                    part = text[i:j]
                    tail = part[1:]
                    if not tail.isalpha() or not (tail.islower() or part.isupper()):
                        break
                    price = self.cost.get(part.lower())
                    if price is not None and best[i] + price < best[j]:
                        best[j], rest[j] = best[i] + price, rest[i]
        if len(self.cache) > 100_000:
            self.cache.clear()
        self.cache[text] = rest[n]
        return rest[n]


def _names(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def context(name: str) -> str:
    """What the name of an assignment says: "secret", "public" or nothing."""
    words = _names(name)
    if not words:
        return ""
    if words[-1] in PUBLIC_NAMES or any(w in ("uuid", "digest", "integrity", "checksum", "public") for w in words):
        return "public"
    if words[-1] in SECRET_NAMES or (words[-1] == "key" and len(words) > 1 and words[-2] in KEY_OWNERS):
        return "secret"
    return "key" if words[-1] in ("key", "signer", "id", "phrase", "pin", "sig", "salt") else ""


def decoded(value: str):
    """The text that ``value`` encodes in base64, or None."""
    if len(value) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", value):
        return None
    try:
        text = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4)).decode("ascii")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None
    return text if text.isprintable() else None


def _classes(value: str) -> int:
    return any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)


class Scanner:
    def __init__(self, words: Words):
        self.words = words

    def secret(self, value: str, where: str, name: str = "") -> bool:
        """Whether a literal is a credential, given its context."""
        if len(value) < 6 or PLACEHOLDER.match(value) or PUBLIC.match(value) or "${" in value:
            return False
        if where == "public":
            return False
        if " " in value.strip():
            parts = value.split()
            return where == "secret" and len(parts) in (12, 15, 18, 21, 24) and all(p.isalpha() and p.islower() for p in parts)
        text = decoded(value) if where in ("secret", "code") else None
        if text and ":" in text and " " not in text and self.words.residual(text.split(":", 1)[1]) >= 3:
            return True
        if "://" in value:
            return False
        rest = self.words.residual(value)
        if where == "secret":
            words = bool(WORD_NAMES & set(_names(name))) if name else True
            # a word password has words of the dictionary and a number or sign besides; with both it is one under any name
            return rest >= (3 if words or MIXED.search(value) else 8) and len(value) >= 8
        if where == "code":
            return False
        if HEX.match(value):
            return False
        # a longer run, or one of base64 signs, is more likely data than a token
        return bool(TOKEN_LIKE.match(value)) and rest >= 16 and _classes(value) == 3 and rest >= 0.6 * len(value)

    def plain(self, value: str) -> bool:
        """Whether :meth:`secret` rejects a literal in every context, being known words alone."""
        return bool(PLAIN.match(value)) and value.count(" ") < 11 and self.words.residual(value) < 3 and ":" not in (decoded(value) or "")

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each credential, in order and without overlaps."""
        if not text:
            return []
        out: list[tuple[int, int, str]] = []
        add = lambda m, kind, g="v": out.append((*m.span(g), kind))
        lower = text.lower()
        has = lambda *parts: any(p in lower for p in parts)
        encoder, secret_name = has("atob", "base64"), has(*NAME_PARTS)
        for m in PRIVATE.finditer(text) if "PRIVATE KEY" in text else ():
            if len(re.sub(r"\\n|\W", "", m["v"])) >= 24:
                add(m, "private key")
        for m in TOKEN.finditer(text):
            if self.words.residual(m.group()) >= 10:
                add(m, "token", 0)
        for m in ASSIGNED.finditer(text):
            value, more = m["v"], m["more"]
            if not more and (len(value) < 6 or (not (encoder and ENCODER.search(m["call"])) and self.plain(value))):
                continue
            before = NAMED.search(text, max(0, m.start() - 100, text.rfind("\n", 0, m.start()) + 1), m.start())
            if before is None:
                continue
            where = context(before["name"])
            if where == "public":
                continue
            if more:
                parts = "".join(a or b for a, b in re.findall(r"\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'", more))
                joined = re.match(r"[ \t]*[+]|[ \t]*\\?\n", more) or "concat" in m["call"]
                if joined and self.secret(value + parts, where, before["name"]):
                    out.append((m.start("v"), m.end("more") - 1, "split literal"))
                    continue
            if encoder and ENCODER.search(m["call"]) and (t := decoded(value)) and self.secret(t.split(":", 1)[-1], "secret"):
                add(m, "encoded")
            elif self.secret(value, where, before["name"]):
                add(m, "assigned")
            elif not where or where == "key":
                for o in (LISTED if ";" in value else OPTION).finditer(value):
                    if context(o["name"]) == "secret" and self.secret(o["v"], "secret", o["name"]):
                        out.append((m.start("v") + o.start("v"), m.start("v") + o.end("v"), "option"))
        for m in CALLED.finditer(text):
            args = [(a, a[2]) for a in ARGUMENT.finditer(m["args"])]
            base, last = m.start("args"), args[-1][1] if args else ""
            callee = CALLEE.search(text, max(0, m.start() - 60), m.start()) if encoder else None
            if encoder and ENCODER.search((callee.group() if callee else "") + m["args"]):
                for a, v in args:
                    t = decoded(v)
                    if t and ":" in t and self.secret(t.split(":", 1)[1], "secret"):
                        out.append((base + a.start(2), base + a.end(2), "encoded"))
            if len(args) >= 2 and len(last) >= 6 and not self.plain(last):
                first = args[-2][1]
                host = len(args) >= 3 and re.fullmatch(r"[\w-]+(?:\.[\w-]+)+(?::\d+)?|localhost", args[0][1])
                named = context(first) == "secret"
                if (host and self.secret(last, "secret")) or (named and self.secret(last, "secret", first)):
                    out.append((base + args[-1][0].start(2), base + args[-1][0].end(2), "argument"))
        for m in UNQUOTED.finditer(text) if secret_name else ():
            if context(m["name"]) == "secret" and not re.fullmatch(r"[\w.]*[A-Za-z_.]\w*", m["v"]) and self.secret(m["v"], "secret", m["name"]):
                add(m, "setting")
        logins = [(USERINFO, "://" in text), (CURL_USER, "-u" in text), (LOGIN_NOTE, has("login", "cred", "account", "pass", "pwd"))]
        for pattern, worth in logins:
            for m in pattern.finditer(text) if worth else ():
                if not PLACEHOLDER.match(m["v"]) and self.secret(m["v"].rstrip("."), "secret"):
                    add(m, "login")
        for m in FALLBACK.finditer(text) if secret_name else ():
            if context(m["name"]) == "secret" and self.secret(m["v"], "secret", m["name"]):
                add(m, "fallback")
        for m in QUERY.finditer(text) if "=" in text else ():
            if (context(m["name"]) in ("secret", "key") or m["name"].lower() in ("key", "sig", "signature")) and self.secret(m["v"], "secret", "token"):
                add(m, "query")
        for m in FORM.finditer(text) if has("password=", "passwd=", "secret=", "token=", "key=") else ():
            if self.secret(m["v"], "secret"):
                add(m, "form")
        for m in HEADER.finditer(text) if has("basic", "bearer") else ():
            t = decoded(m["v"])
            if (t and ":" in t) if m["kind"].lower() == "basic" else self.words.residual(m["v"]) >= 12:
                add(m, "header")
        for m in KEY_HEADER.finditer(text) if has("x-") else ():
            if self.words.residual(m["v"]) >= 10 and not PLACEHOLDER.match(m["v"]):
                add(m, "header")
        for m in WALLET.finditer(text) if "0x" in text else ():
            if m.group().strip("0x") and NOTED.search(text, max(0, m.start() - 60), m.start()):
                add(m, "private key", 0)
        found, end = [], -1
        for a, b, kind in sorted(out):
            if a >= end:
                found.append((a, b, kind))
                end = b
        return found


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each credential replaced inside its quotes.

    A split literal keeps its quotes and operators: letters and digits of the
    parts are replaced, so that the expression around them still parses.
    """
    out, at = [], 0
    for a, b, kind in found:
        value = text[a:b]
        if kind == "split literal":
            pieces = re.split(r"""(["'][^"'\w]*["'])""", value)
            value = "".join(p if i % 2 else "REDACTED" if i == 0 else "" for i, p in enumerate(pieces))
        elif kind == "encoded":
            value = base64.b64encode(b"REDACTED").decode()
        elif re.fullmatch(r"0x[0-9a-fA-F]+", value):
            value = "0x" + "0" * (len(value) - 2)
        else:
            value = "REDACTED"
        out += [text[at:a], value]
        at = b
    return "".join([*out, text[at:]])


def dictionary(records: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """The ``size`` most frequent words of all records, by number of records."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            seen[""] += len(batch)
            for text in batch["text"]:
                seen.update({w.lower() for w in _subword.findall(text)})
            if len(seen) > 200_000:
                yield pd.DataFrame(list(seen.items()), columns=["word", "n"])
                seen = Counter()
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"]).astype({"word": "object", "n": "int64"})

    counted = records.select("text").where("text is not null").mapInPandas(count, "word string, n bigint")
    # the records themselves are counted under the empty word, which sorts first
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    n = {r.word: r.n for r in top}
    least = LEAST_SHARE * n.pop("", 0)
    return {w: c for w, c in n.items() if SHORT <= len(w) <= LONGEST_WORD and c >= max(2, least * (5 if len(w) == SHORT else 1))}


def credentials(records: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(source_table, project, record_key, kinds, redacted) of each record with a credential.

    ``records`` has source_table, project, record_key and text.
    """
    spark = records.sparkSession
    words = spark.sparkContext.broadcast(dictionary(records, size))

    def scan(batches):
        scanner = Scanner(Words(words.value))
        for batch in batches:
            out = []
            for table, project, key, text in zip(*(batch[c] for c in ("source_table", "project", "record_key", "text"))):
                found = scanner.find(text)
                if found:
                    out.append((table, project, key, sorted({k for _, _, k in found}), redacted(text, found)))
            yield pd.DataFrame(out, columns=["source_table", "project", "record_key", "kinds", "redacted"])

    found = records.where("text is not null and record_key is not null").mapInPandas(
        scan, "source_table string, project string, record_key string, kinds array<string>, redacted string"
    )
    return found.dropDuplicates(["source_table", "project", "record_key"])


def code_records(nodes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """The three tables as (source_table, project, record_key, text)."""
    row = lambda df, name, key, text: df.select(F.lit(name).alias("source_table"), "project", F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"))
    return (
        row(nodes, "nodes", "node_id", "body")
        .unionByName(row(commits, "git_commits", "commit_hash", "diff_summary"))
        .unionByName(row(files, "files", "file_path", "content"))
    )
