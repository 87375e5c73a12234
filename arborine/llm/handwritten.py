"""Source files that no person wrote by hand for their repository, by belief propagation over folders.

Every repository is a tree: folders inside, documents as leaves. Each node has one of five labels:
hand (written by hand), gen (made by a tool), mini (minified), vend (third-party copy), blob (data kept as code). A leaf's evidence
comes from its text and name and from equal code in other repositories; a folder's from its own name alone.
``COMPATIBLE`` says how likely a child has each label below a parent of each label, so what is known of
siblings and of folders above reaches a file through its folder. On a tree two passes are exact: messages run up
level by level, where a folder adds those of its children, and back down; every pass over a level is one grouped
sum or one join in Spark, and sums are combined before the shuffle, so a folder may hold any
share of the files.

Whole texts are read. What a text says of its origin is looked for in the comments outside blocks, wherever they stand. A
copyright holder or licence that a good part of a repository's files name is the repository's own and speaks for nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborine.functions.languages import EXTENSIONS
from arborine.operators.skew import join_skewed
from arborine.sources.scratch import Scratch
from arborine.sources.tables import for_all_cores

LABELS = ("hand", "gen", "mini", "vend", "blob")
#: Chance of a child's label (column) below a parent's (row).
COMPATIBLE = {
    "hand": (0.92, 0.02, 0.01, 0.04, 0.01),
    "gen": (0.35, 0.55, 0.03, 0.04, 0.03),
    "mini": (0.45, 0.03, 0.44, 0.05, 0.03),
    "vend": (0.01, 0.005, 0.005, 0.975, 0.005),
    "blob": (0.45, 0.03, 0.03, 0.03, 0.46),
}
ROOT = (0.0, -3.0, -3.0, -3.0, -3.0)
#: Folder names that speak for a label, with the weight of what they say of that folder (fixed values).
FOLDERS = {
    **dict.fromkeys(("node_modules", "vendor", "_vendor", "vendored", "third_party", "thirdparty", "third-party", "extern", "bower_components", "site-packages"), ("vend", 9.0)), "external": ("vend", 3.0), "deps": ("vend", 2.0), "contrib": ("vend", 1.0),
    "generated": ("gen", 3.0), "__generated__": ("gen", 4.0), "gen": ("gen", 2.5), "autogen": ("gen", 4.0), "dist": ("mini", 1.0), "min": ("mini", 1.0),
}
_PIECE = re.compile(
    r'(?P<t>"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z))|(?P<c>/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|//[^\n]*|^[ \t]*(?:#(?![ \t]*(?:include|define|if|el|end|pragma|undef)|!?\[)|--(?=[ \[]))[^\n]*)|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', re.M
)
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`]*`|\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)\b|\b(?:true|false|null|nil|None|True|False)\b|[,\[\]{}:()+]')
_SIGNS = re.compile(r"^[\s/#*\"';<!-]+", re.M)
_THING = r"(?:parser|scanner|lexer|code|files?|source|form implementation|bindings?|stubs?|modules?|class(?:es)?|headers?|interface|wrapper|client|schema|grammar|resources?|tables?|messages?)"
_DID = r"(?:(?:auto(?:matically)?|machine)[- ]?)?(?:generated|produced|created|built|made)"
#: What generators write at the start of a comment line, in several languages (fixed values).
_MADE = re.compile(
    rf"^(?:@generated\b|<auto-?generated|auto-?generated\b(?! (?:method|function|constructor|catch|getter|setter|member|stub|block|body|todo))|machine[- ]generated\b|generated (?:by|from|automatically|on|using|with|code|file|source)\b|(?:please )?do not (?:edit|modify|change|alter)(?:,| or|\b(?= (?:by hand|manually|this|it|directly|the))|[.!]*$| -|;)"
    rf"|(?:[\w-]+ ){{0,4}}{_THING}[ ,:]*(?:(?:is|was|were|has been|have been|are) )?{_DID}(?: automatically)? (?:by|from|with|using|on|automatically)\b|(?:[\w-]+ ){{0,4}}{_THING} (?:is|was|were|are|has been) (?:auto-?|automatically )(?:generated|produced|created)"
    rf"|(?:[\w-]+ ){{0,3}}{_THING}, (?:made|generated|produced) by|(?:end of )?output of (?:the )?[\w./-]*gen(?:erator)?\b|source: \S+\.\w+|any edit is overwritten|manual changes will be lost"
    r"|automatisch (?:erzeugt|generiert|erstellt)|g[ée]n[ée]r[ée] automatiquement|fichier g[ée]n[ée]r[ée]|generado autom[áa]ticamente|archivo generado|gerado automaticamente|generato automaticamente|автоматически сгенерирован|.{0,12}(?:自動生成|自动生成|자동 생성))"
    r"|\b(?:generated|made) by [^\n]*\b(?:do not (?:edit|modify)|edit [^\n]* instead)\b|[.;,-] *(?:please )?do not (?:edit|modify|change)[.! ]*$",
    re.I | re.M,
)
#: What notices say of another project: a licence, where the text was taken from, a release with its address (fixed values).
_LICENCE = re.compile(r"Permission is hereby granted|Redistribution and use in source|\b(MIT|BSD|Apache|ISC|MPL|L?GPL|AGPL|zlib|Boost|Unlicense)\b[^\n]{0,40}\bLicen[sc]ed?\b|SPDX-License-Identifier: *(\S+)|Licensed under the ([\w ]+)", re.I)
_TAKEN = re.compile(r"\b(?:copied|imported|vendored|ported|adapted|taken|borrowed|mirrored|forked|extracted)\b(?: \w+){0,3} from\b|\bunchanged from upstream\b|\bupstream (?:version|release|source|commit)\b", re.I)
_RELEASE = re.compile(r"(?<![\w.])v?\d+\.\d+(?:\.\d+)?(?![\w.]*/)", re.I)
_ADDRESS = re.compile(r"https?://|homepage|website", re.I)
_HOLDER = re.compile(r"(?:SPDX-FileCopyrightText:|copyright(?: \(c\)| ©)?|\(c\)|©)[ :]*(?:\d{4}(?:[-, ]+\d{4})*[ ,]*)?(?:by |the )?([^\n,;|]{2,60})", re.I)
_BANNER = re.compile(r"/\*![^*]{3,}")
_MAP = re.compile(r"sourceMappingURL=")
_FUNCTION = re.compile(r"(?:\b(?:def|function|func|fn|sub|fun)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)\s*[(<])|\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\([^)\n]*\)[^=\n]*=>|^[ \t]*(?:[\w<>\[\]*&]+[ \t]+)*\*?([A-Za-z_]\w*)[ \t]*\([^;{}\n]*\)[^;{}=\n]*\{[ \t]*$", re.M)
_CONTROL = frozenset("if for while switch catch else return do try with synchronized function".split())
_ACCESS = re.compile(r"(get|set)(.+)", re.I)
_NAME_MADE = re.compile(r"(?:_pb2(?:_grpc)?|\.pb|_gen|_generated|\.gen|\.generated|\.g|_autogen|\.designer)$", re.I)
#: Signs of code at which sizes begin to count in full, and the weight of equal code in another repository.
ENOUGH, EQUAL = 120, 8.0
#: What a text without any sign of another project says against a third-party copy, as most copies have one.
UNMARKED = 1.2
#: A holder or licence is the repository's own if at least this share of its files, and so many, name it.
OWN_SHARE, OWN_FILES = 0.1, 5


def pieces(text: str) -> tuple[str, list[str]]:
    """The code of a text without comments, and its comments outside blocks: at no depth of curly brackets and, where they are indented, never."""
    code, notes, at, depth, fresh = [], [], 0, 0, True
    for m in _PIECE.finditer(text):
        if m.lastgroup is None:
            continue
        part = text[at : m.start()]
        code.append(part)
        depth = max(0, depth + part.count("{") - part.count("}"))
        lead = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if m.lastgroup == "t" and lead.strip():  # a long string that is a value
            code.append(m[0])
        else:
            code.append(" ")
            fresh = fresh and not part.strip()
            if depth == 0 and (fresh or not lead and m[0][0] not in " \t"):
                notes.append(m[0])
        at = m.end()
    code.append(text[at:])
    return "".join(code), notes


def repetition(names: list[str]) -> float:
    """Share of function names that are numbered in a row or come as get and set of one thing."""
    if len(names) < 3:
        return 0.0
    numbered = sum(n[-1].isdigit() and bool(re.search(r"[A-Za-z_](?:0\d+|\d+)$", n)) for n in names)
    things: dict[str, set[str]] = {}
    for n in names:
        if m := _ACCESS.fullmatch(n):
            things.setdefault(m[2].lower().strip("_"), set()).add(m[1].lower())
    paired = sum(1 for n in names if (m := _ACCESS.fullmatch(n)) and len(things[m[2].lower().strip("_")]) == 2)
    return max(numbered, paired) / len(names)


def evidence(text: str, path: str, repo: str | None) -> tuple[list[float], str | None, float, str | None, float]:
    """Log weights of the five labels for one text; a digest of its code without comments and white space and what equal code elsewhere weighs; whom the text names as its owner and what that weighs if it is no owner of the repository.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    name = path.rsplit("/", 1)[-1].rpartition(".")[0]
    code, found = pieces(text)
    tight = "".join(code.split())
    n = len(tight)
    sure = min(1.0, n / ENOUGH)
    weight = dict.fromkeys(LABELS, 0.0)
    literal = sum(len("".join(m[0].split())) for m in _LITERAL.finditer(code)) / max(n, 1)
    lines = [line for line in code.split("\n") if line.strip()]
    width = sum(map(len, lines)) / max(len(lines), 1)
    dense = n / max(len(code.strip()), 1)
    blob = literal >= 0.6
    mini = not blob and dense > 0.88 and width > 60
    weight["blob"] += 9.0 * sure if blob else -9.0
    weight["mini"] += 9.0 * sure if mini else -9.0
    if ".min" in name[-4:] or name.endswith(("-min", ".bundle")):
        weight["mini"] += 2.0
    notes = _SIGNS.sub("", "\n".join(found))
    if mini:
        weight["mini"] += (1.0 if _BANNER.search(text) else 0.0) + (2.0 if _MAP.search(notes) else 0.0)
    names = [x for m in _FUNCTION.finditer(code) if (x := m[1] or m[2] or m[3]) and x not in _CONTROL] if not blob and not mini else []
    same = repetition(names)
    weight["gen"] += (8.0 if _MADE.search(notes) else -1.0) + (7.0 if same >= 0.6 else 2.0 if same >= 0.4 else -2.0 if names else 0.0)
    if _NAME_MADE.search(name):
        weight["gen"] += 2.5
    head = found[0] if found else ""
    first = _SIGNS.sub("", "\n".join(found[:8]))
    licence, holder, taken = _LICENCE.search(first), _HOLDER.search(first), _TAKEN.search(notes)
    release = bool(_RELEASE.search(head)) and bool(_ADDRESS.search(head) or taken or licence)
    who = holder[1].strip(" .").lower() if holder else None
    claimed = 0.0
    if who and repo and re.search(rf"(?<![\w-]){re.escape(repo.lower())}(?![\w-])", who):
        weight["hand"] += 3.0
        who = None
    else:
        claimed = (3.5 if licence else 0.0) + (3.5 if who else 0.0)
        who = who or (f"licence {next((g for g in licence.groups() if g), licence[0])}".lower() if licence else None)
        weight["vend"] += (4.0 if taken else 0.0) + (3.5 if release else 0.0) - (0.0 if taken or release or claimed else UNMARKED)
    digest = hashlib.md5(tight.encode("utf-8", "surrogatepass")).hexdigest() if n and not blob else None
    return [weight[k] for k in LABELS], digest, EQUAL * (1.0 - math.exp(-n / ENOUGH)), who, claimed


def _file_table(documents: DataFrame) -> DataFrame:
    """(doc_id, path, root, seen, digest, equal, owner, claimed, one weight per label) of every file to judge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, made = [], []
            for i, (path, repo, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)))):
                if EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower()) and text.strip():
                    keep.append(i)
                    made.append(evidence(text, path, repo))
            at = pa.array(keep, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), *(pa.array([x[k] for x in made], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.string()), (4, pa.float64()))), *(pa.array([x[0][k] for x in made], pa.float64()) for k in range(len(LABELS)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "seen", "digest", "equal", "owner", "claimed", *LABELS])

    seen = F.col("fetched_at").cast("timestamp").cast("double") if "fetched_at" in documents.columns else F.lit(0.0)
    rows = documents.where(F.col("path").contains(".") & F.col("text").isNotNull()).select("doc_id", "path", seen.alias("seen"), "repo", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return for_all_cores(rows, "doc_id").mapInArrow(run, f"doc_id {kind}, path string, seen double, digest string, equal double, owner string, claimed double, " + ", ".join(f"{k} double" for k in LABELS)).withColumn("root", F.substring_index("path", "/", 1))


def _message(rows: DataFrame, sources: list[str], targets: list[str], upward: bool) -> DataFrame:
    """``rows`` with the columns ``targets``: the message of a node of log belief ``sources`` to its parent's labels, or to its child's.

    Each message is centred on its greatest entry, as only the differences matter.
    """
    table = np.log(np.array([COMPATIBLE[k] for k in LABELS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            belief = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in sources])
            terms = belief[:, None, :] + table[None, :, :] if upward else belief[:, None, :] + table.T[None, :, :]
            top = terms.max(2, keepdims=True)
            out = (top + np.log(np.exp(terms - top).sum(2, keepdims=True)))[:, :, 0]
            out -= out.max(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k]) for k in range(len(LABELS)))], [*batch.schema.names, *targets])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, " + ", ".join(f"{t} double" for t in targets))


def _parent(path: str) -> Column:
    """The folder of a path; '' above the top."""
    return F.regexp_replace(F.col(path), r"/?[^/]*$", "")


def _said(label: str, folders: dict[str, tuple[str, float]]) -> Column:
    """What a folder's own name says for a label."""
    said = [x for name, (k, w) in folders.items() if k == label for x in (F.lit(name), F.lit(w))]
    return F.coalesce(F.try_element_at(F.create_map(*said), F.lower(F.substring_index("dir", "/", -1))), F.lit(0.0)) if said else F.lit(0.0)


def _known(files: DataFrame, n_files: int) -> DataFrame:
    """(doc_id, path, dir, one weight per label): the evidence of each file with what other files say of it.

    Equal code in another repository speaks for a copy, but not in the repository it seems to come from: that of the file with the
    least evidence of a copy, of equals the one fetched first.
    """
    copied = F.col("vend") + F.col("claimed") + F.when(F.lower("path").rlike("/(?:" + "|".join(n for n, (k, w) in FOLDERS.items() if k == "vend" and w > 3) + ")/"), 9.0).otherwise(0.0)
    origin = F.struct(copied.alias("copied"), F.coalesce("seen", F.lit(float("inf"))).alias("seen"), "path")
    texts = files.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct(origin.alias("o"), "root")).alias("first"), F.min("root").alias("a"), F.max("root").alias("b"))
    texts = texts.where("a <> b").select("digest", F.col("first.root").alias("origin"))
    met = join_skewed(files, texts, "digest", n_files, "left")
    met = met.withColumn("_equal", F.when(F.col("origin") != F.col("root"), F.col("equal")).otherwise(0.0)).withColumn("_named", F.concat_ws("\n", "root", "owner")).drop("origin")
    named = files.where(F.col("owner").isNotNull()).groupBy("root", "owner").agg(F.count(F.lit(1)).alias("n"))
    sizes = files.groupBy("root").agg(F.count(F.lit(1)).alias("all"))
    own = named.join(sizes, "root").where((F.col("n") >= OWN_FILES) & (F.col("n") >= F.col("all") * OWN_SHARE)).select(F.concat_ws("\n", "root", "owner").alias("_named"), F.lit(True).alias("_own"))
    met = join_skewed(met, own, "_named", n_files, "left")
    vend = F.col("vend") + F.col("_equal") + F.when(F.col("_own"), F.lit(-UNMARKED)).otherwise(F.col("claimed"))
    return met.select("doc_id", "path", _parent("path").alias("dir"), *(vend.alias(k) if k == "vend" else F.col(k) for k in LABELS))


def file_labels(documents: DataFrame, folders: dict[str, tuple[str, float]] = FOLDERS) -> DataFrame:
    """(doc_id, path, label, confidence) of every document with a supported extension and a text that is not blank.

    ``confidence`` is the label's chance after propagation. Texts fetched again are leaves of their own, repeated rows
    stay repeated, a null ``repo`` only takes away the evidence of an owner of that name; null paths and null, empty or blank
    texts give no row; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "handwritten")
    files = scratch.save(_file_table(documents), "files")
    n_files = files.count()
    depth = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))
    up, above = [f"u_{k}" for k in LABELS], [f"a_{k}" for k in LABELS]
    rest = [F.coalesce(F.col(a) - F.col(u), F.lit(ROOT[i])).alias(a) for i, (a, u) in enumerate(zip(above, up))]
    leaves = scratch.save(_message(_known(files, n_files), list(LABELS), up, True), "leaf")
    below = scratch.save(leaves.groupBy("dir").agg(*(F.sum(u).alias(k) for u, k in zip(up, LABELS))).withColumn("level", depth("dir")), "below")
    deepest = below.agg(F.max("level")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    for level in range(deepest, 0, -1):
        parts = below.where(F.col("level") == level).drop("level")
        if level + 1 in levels:
            parts = parts.unionByName(levels[level + 1].select(_parent("dir").alias("dir"), *(F.col(u).alias(k) for u, k in zip(up, LABELS))))
        held = parts.groupBy("dir").agg(*(F.sum(k).alias(k) for k in LABELS)).select("dir", *((F.col(k) + _said(k, folders) + (F.lit(ROOT[i]) if level == 1 else F.lit(0.0))).alias(k) for i, k in enumerate(LABELS)))
        levels[level] = scratch.save(_message(held, list(LABELS), up, True), f"up{level}")
    told = levels.get(1, below.select("dir", *LABELS))
    whole = told.select("dir", *LABELS)
    for level in range(2, deepest + 1):
        over = told.select(F.col("dir").alias("above"), *(F.col(k).alias(a) for k, a in zip(LABELS, above)))
        children = levels[level].withColumn("above", _parent("dir"))
        met = join_skewed(children, over, "above", children.count(), "left").select("dir", *LABELS, *rest)
        down = _message(met, above, [f"d_{k}" for k in LABELS], False)
        told = scratch.save(down.select("dir", *((F.col(k) + F.col(f"d_{k}")).alias(k) for k in LABELS)), f"down{level}")
        whole = whole.unionByName(told)
    asked = whole.select("dir", *(F.col(k).alias(a) for k, a in zip(LABELS, above)))
    met = join_skewed(leaves, asked, "dir", n_files, "left").select("doc_id", "path", *LABELS, *rest)
    down = _message(met, above, [f"d_{k}" for k in LABELS], False)
    final = down.select("doc_id", "path", *((F.col(k) + F.col(f"d_{k}")).alias(k) for k in LABELS))
    best = F.greatest(*LABELS)
    total = sum((F.exp(F.col(k) - best) for k in LABELS[1:]), F.exp(F.col(LABELS[0]) - best))
    label = F.coalesce(*(F.when(F.col(k) == best, k) for k in LABELS))
    return final.select("doc_id", "path", label.alias("label"), F.round(1 / total, 6).alias("confidence"))


def label_shares(labels: DataFrame) -> DataFrame:
    """(repo, label, files) with the repository taken from the path."""
    return labels.groupBy(F.substring_index("path", "/", 1).alias("repo"), "label").agg(F.count(F.lit(1)).alias("files"))

