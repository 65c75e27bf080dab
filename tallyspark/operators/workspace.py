"""Layout rules of a book's workspace, over rows (workspace, path, is_dir) of its tree.

Paths are relative to the workspace; ``skills`` has (workspace, path, content) of the skill files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import report

# What an edition must, may and must not have. Folders of covers are the caller's.
EDITION_FOLDERS = ("assets/figures", "assets/fonts", "book/chapters", "editorial/content-audit", "output/audit", "output/build", "output/preview")
EDITION_FILES = ("book/covers.typ", "book/core.typ", "book/main.typ", "book/matter.typ", "book/template.typ", "book.toml", "source-map.json")
EDITION_ROOT = ("assets", "book", "editorial", "output", "book.toml", "source-map.json")
EDITION_FORBIDDEN = ("source", "sources", "raw", "markdown", "scripts")
MARKDOWN_ROOT = ("chapters", "images")
SUFFIXES = {"zh": ("zh",), "en": ("en", "dual", "zh")}
SKILL_FOLDER = ".agents/skills"
COVERS = ("own", "source")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _child(path: Column, folder: Column) -> Column:
    """Whether ``path`` lies directly in ``folder``."""
    return F.startswith(path, F.concat(folder, F.lit("/"))) & ~F.contains(F.substr(path, F.char_length(folder) + 2), F.lit("/"))


def _under(path: Column, folder: Column) -> Column:
    return F.startswith(path, F.concat(folder, F.lit("/")))


def _name(path: Column) -> Column:
    return F.element_at(_parts(path), -1)


def required(workspace: Column, language: str, covers: tuple[str, ...] = COVERS) -> Column:
    """An array of everything that must be there: path, is_dir and the edition that it lies in (null outside editions)."""
    entry = lambda path, is_dir, edition=None: F.struct(
        path.alias("path"), F.lit(is_dir).alias("is_dir"), (F.lit(None).cast("string") if edition is None else edition).alias("edition")
    )
    found = [entry(F.concat(workspace, F.lit(x)), True) for x in ("-raw", "-markdown", "-markdown/chapters", "-markdown/images")]
    found.append(entry(F.lit(SKILL_FOLDER), True))
    for suffix in SUFFIXES[language]:
        edition = F.concat(workspace, F.lit(f"-typst-{suffix}"))
        found.append(entry(edition, True))
        found += [entry(F.concat(edition, F.lit(f"/{x}")), True, edition) for x in (*[f"assets/covers/{c}" for c in covers], *EDITION_FOLDERS)]
        found += [entry(F.concat(edition, F.lit(f"/{x}")), False, edition) for x in EDITION_FILES]
    return F.array(*found)


def findings(paths: DataFrame, skills: DataFrame, language: str, covers: tuple[str, ...] = COVERS) -> DataFrame:
    """All findings on the workspaces that ``paths`` names; subject is ``workspace: path``.

    One pass looks at each path by itself. Another brings every workspace to one row of facts by
    partial sums: which of the required entries it has, how many files are where, its skills.
    ``covers`` names the folders of covers that an edition has.
    """
    if language not in SUFFIXES:
        raise ValueError(f"language is one of {sorted(SUFFIXES)}")
    w, p, is_dir = F.col("workspace"), F.col("path"), F.col("is_dir")
    subject = F.concat_ws(": ", w, p)
    raw, markdown = F.concat(w, F.lit("-raw")), F.concat(w, F.lit("-markdown"))
    chapters = F.concat(markdown, F.lit("/chapters"))
    editions = [F.concat(w, F.lit(f"-typst-{s}")) for s in SUFFIXES[language]]
    of_edition = lambda test: F.exists(F.array(*editions), test)
    is_top, name = ~p.contains("/"), _name(p)
    edition_root = of_edition(lambda e: _child(p, e))
    own_skill = (F.size(_parts(p)) == 4) & F.startswith(p, F.lit(f"{SKILL_FOLDER}/")) & (name == "SKILL.md")
    allowed = F.array(F.lit(".agents"), F.lit(".git"), raw, markdown, *editions)
    in_git = F.array_contains(_parts(p), ".git")
    by_path = report.flagged(
        paths,
        ("typeset file in raw folder", _under(p, raw) & F.lower(p).endswith(".typ"), subject),
        ("unexpected entry in text folder", _child(p, markdown) & ~name.isin(*MARKDOWN_ROOT), subject),
        ("chapter of another type", _under(p, chapters) & ~is_dir & ~F.lower(p).endswith(".md"), subject),
        ("unexpected edition", is_top & is_dir & F.startswith(p, F.concat(w, F.lit("-typst-"))) & ~of_edition(lambda e: p == e), subject),
        ("unexpected entry in workspace", is_top & ~F.array_contains(allowed, p), subject),
        ("unexpected entry in edition", edition_root & ~name.isin(*EDITION_ROOT), subject),
        ("forbidden entry in edition", edition_root & name.isin(*EDITION_FORBIDDEN), subject),
        ("nested repository", in_git & (_parts(p)[0] != ".git") | (p == ".gitmodules"), subject),
        ("upper case in path", ~_under(p, raw) & (p != raw) & ~in_git & ~own_skill & p.rlike("[A-Z]"), subject),
    )
    wanted = required(w, language, covers)
    asked = F.exists(wanted, lambda r: (r.path == p) & (r.is_dir == is_dir))
    facts = paths.groupBy("workspace").agg(
        F.collect_set(F.when(asked, F.struct("path", "is_dir"))).alias("there"),  # no more than ``required`` has
        F.bool_or((p == raw) & is_dir).alias("has_raw"),
        F.count_if(_under(p, raw) & ~is_dir).alias("raw_files"),
        F.bool_or((p == chapters) & is_dir).alias("has_chapters"),
        F.count_if(_under(p, chapters) & ~is_dir).alias("chapter_files"),
        F.bool_or((p == SKILL_FOLDER) & is_dir).alias("has_skills"),
        F.count_if(own_skill & ~is_dir).alias("n_skills"),
        F.min(F.when(own_skill & ~is_dir, p)).alias("skill"),
    )
    has = lambda r: F.array_contains(F.col("there"), F.struct(r.path.alias("path"), r.is_dir.alias("is_dir")))
    # Entries of an edition are asked for only where the edition itself is there.
    needed = F.filter(wanted, lambda r: r.edition.isNull() | F.array_contains(F.col("there"), F.struct(r.edition.alias("path"), F.lit(True).alias("is_dir"))))
    absent = F.filter(needed, lambda r: ~has(r))
    slug = _parts(F.col("skill"))[2]
    facts = facts.join(skills.select("workspace", F.col("path").alias("skill"), F.regexp_extract("content", r"(?m)^name:\s*([^\s#]+)\s*$", 1).alias("name")), ["workspace", "skill"], "left")
    single = F.col("n_skills") == 1
    skill = F.concat_ws(": ", w, F.col("skill"))
    by_space = report.flagged(
        facts,
        ("workspace name", w.rlike("[A-Z]") | (~text.is_slug(w) if language == "en" else F.lit(False)), w),
        ("raw folder empty", F.col("has_raw") & (F.col("raw_files") == 0), F.concat_ws(": ", w, raw)),
        ("no chapters", F.col("has_chapters") & (F.col("chapter_files") == 0), F.concat_ws(": ", w, chapters)),
        ("not one local skill", F.col("has_skills") & ~single, w, F.col("n_skills")),
        ("skill name is no slug", single & ~text.is_slug(slug), skill),
        ("skill without a name", single & (F.col("name") == ""), skill),
        ("skill named otherwise", single & (F.col("name") != "") & (F.col("name") != slug), skill, F.col("name")),
    )
    gaps = facts.select("workspace", F.inline(absent)).select(
        F.when(is_dir, "folder missing").otherwise("file missing").alias("check"), F.lit("FAIL").alias("severity"), subject.alias("subject"), F.lit("").alias("detail")
    )
    return report.all_of([by_path, by_space, gaps])
