"""Suggested edits, user decisions and their effect on texts and results.

patches(doc_id, paragraph_id, start, end, original, replacement, group_id)
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.functions.apa import italic_html, restore_year_suffix as _suffix
from refaudit.functions.reference import is_turkish
from refaudit.functions.text import clean_ws, escape_html, nfc, split_sentences

from refaudit.session import stage_table

from .citations import BIB_HEADING, BODY, with_identity
from .shaping import with_computed


def suggest_patches(audited: DataFrame) -> DataFrame:
    """Patches of the audit, one group per citation; a manual match may bring two (year and author)."""
    patch = "struct<start:int,end:int,original:string,replacement:string>"
    one = F.when(F.col("patch").isNotNull(), F.array(F.col("patch").cast(patch)))
    both = F.coalesce(F.col("manual_patches").cast(f"array<{patch}>"), one) if "manual_patches" in audited.columns else one
    return audited.select("doc_id", "paragraph_id", F.col("citation_id").alias("group_id"), F.inline(both)).select("doc_id", "paragraph_id", "start", "end", "original", "replacement", "group_id")


def entry_patches(refs: DataFrame, paragraphs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Whole-paragraph replacements for accepted entry texts ``outputs(doc_id, ref_id, text)``.

    An entry spread over several paragraphs puts its text into the first and empties the rest.
    """
    rows = refs.join(outputs, ["doc_id", "ref_id"]).select("doc_id", "ref_id", "text", F.posexplode("paragraphs").alias("n", "paragraph_id"))
    par = paragraphs.select("doc_id", "paragraph_id", F.col("text").alias("original"))
    return rows.join(par, ["doc_id", "paragraph_id"]).select(
        "doc_id", "paragraph_id", F.lit(0).alias("start"), F.length("original").alias("end"), "original",
        F.when(F.col("n") == 0, F.col("text")).otherwise(F.lit("")).alias("replacement"), F.concat(F.lit("bib-"), F.col("ref_id")).alias("group_id"))


def running_offsets(patches: DataFrame) -> DataFrame:
    """Shift caused by the earlier patches of the same paragraph."""
    w = Window.partitionBy("doc_id", "paragraph_id").orderBy("start", "end", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.length("replacement") - (F.col("end") - F.col("start"))
    return patches.withColumn("offset", F.coalesce(F.sum(delta).over(w), F.lit(0)).cast("int"))


def overlapping_patches(patches: DataFrame) -> DataFrame:
    """Patches that begin before an earlier patch of the paragraph has ended."""
    w = Window.partitionBy("doc_id", "paragraph_id").orderBy("start", "end", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    return patches.withColumn("_reach", F.max("end").over(w)).where(F.col("_reach") > F.col("start")).drop("_reach")


def _meet(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def _marked(paragraphs: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches with ``fits`` (the original text is there, the paragraph free, no other patch of the group overlaps) and ``clash`` (one of another group does).

    Patches meet the text once, gathered by paragraph, so that both flags come from the row itself.
    """
    here = patches.groupBy("doc_id", "paragraph_id").agg(F.collect_list(F.struct("start", "end", "original", "replacement", "group_id")).alias("here"))
    text = paragraphs.select("doc_id", "paragraph_id", F.col("text").alias("_text"), F.coalesce("protected", F.lit(False)).alias("_locked"))
    rows = here.join(text, ["doc_id", "paragraph_id"], "left")

    def others(x: Column, same: bool, me: Column) -> Column:
        own = (x["group_id"] == F.get("here", me)["group_id"]) if same else (x["group_id"] != F.get("here", me)["group_id"])
        return own & _meet(x, F.get("here", me))

    def flags(x: Column, i: Column) -> Column:
        there = F.coalesce(~F.col("_locked") & (F.substring(F.col("_text"), x["start"] + 1, x["end"] - x["start"]) == x["original"]), F.lit(False))
        alone = F.size(F.filter("here", lambda y: others(y, True, i))) <= F.when(x["start"] < x["end"], 1).otherwise(0)  # it overlaps itself unless empty
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"), x["group_id"].alias("group_id"),
                        (there & alone).alias("fits"), F.exists("here", lambda y: others(y, False, i)).alias("clash"))
    return stage_table(rows.select("doc_id", "paragraph_id", F.inline(F.transform("here", flags))), "marked-patches")


def accepted_groups(marked: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the groups that are applied when all are tried in the order of their first patches.

    A group is applied whole if all its patches fit and none overlaps a patch applied before it; so a refused group refuses nobody.
    Groups that overlap no other are settled at once. Of the rest each round applies those with no undecided earlier group in
    their way and refuses those that overlap them, until none is left: half as many rounds as the longest chain has groups.
    """
    at = F.min(F.struct("paragraph_id", "start", "end", "group_id")).alias("at")
    valid = marked.groupBy("doc_id", "group_id").agg(F.bool_and("fits").alias("ok"), F.bool_or("clash").alias("clash"), at).where("ok")
    taken = valid.where("not clash").select("doc_id", "group_id")
    left = stage_table(marked.select("doc_id", "paragraph_id", "start", "end", "group_id").join(valid.where("clash").select("doc_id", "group_id", "at"), ["doc_id", "group_id"]), "contested-patches")

    def flagged(rows: DataFrame, hit) -> DataFrame:
        """Groups with whether ``hit(patch, other)`` holds for any two overlapping patches of different groups."""
        here = rows.groupBy("doc_id", "paragraph_id").agg(F.collect_list(F.struct("start", "end", "group_id", "at", "won")).alias("here"))
        each = here.select("doc_id", F.inline(F.transform("here", lambda x: F.struct(x["group_id"].alias("group_id"), F.exists("here", lambda y: (x["group_id"] != y["group_id"]) & _meet(x, y) & hit(x, y)).alias("hit")))))
        return each.groupBy("doc_id", "group_id").agg(F.bool_or("hit").alias("hit"))
    while left.limit(1).count():
        won = stage_table(flagged(left.withColumn("won", F.lit(False)), lambda x, y: y["at"] < x["at"]).where(~F.col("hit")).select("doc_id", "group_id"), "won-groups")
        rows = left.join(won.withColumn("won", F.lit(True)), ["doc_id", "group_id"], "left").withColumn("won", F.coalesce("won", F.lit(False)))
        undecided = flagged(rows, lambda x, y: y["won"]).where(~F.col("hit")).select("doc_id", "group_id").join(won, ["doc_id", "group_id"], "left_anti")
        left = stage_table(left.join(undecided, ["doc_id", "group_id"], "left_semi"), "contested-patches")
        taken = taken.union(won)
    return taken


def apply_patches(paragraphs: DataFrame, patches: DataFrame) -> DataFrame:
    """Paragraph texts with the patches applied from right to left, group by group or not at all."""
    marked = _marked(paragraphs, patches)
    done = marked.join(accepted_groups(marked), ["doc_id", "group_id"], "left_semi")
    each = done.groupBy("doc_id", "paragraph_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", "replacement")))).alias("_p"))
    joined = paragraphs.join(each, ["doc_id", "paragraph_id"], "left")
    text = F.aggregate("_p", F.col("text"), lambda t, x: F.concat(
        F.substring(t, F.lit(1), x["start"]), x["replacement"], F.substring(t, x["end"] + 1, F.length(t))))
    return joined.select(*[F.coalesce(text, F.col("text")).alias("text") if c == "text" else F.col(c) for c in paragraphs.columns])


def rejected_patches(paragraphs: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches of refused groups: a member's original text is not there, its paragraph is protected, or it overlaps a group applied before."""
    return patches.join(accepted_groups(_marked(paragraphs, patches)), ["doc_id", "group_id"], "left_anti")


def undo(patches: DataFrame, groups: DataFrame) -> DataFrame:
    """Patches without the withdrawn groups."""
    return patches.join(groups.select("doc_id", "group_id").distinct(), ["doc_id", "group_id"], "left_anti")


def invalidate(evidence: DataFrame, citations: DataFrame, changed_refs: DataFrame) -> DataFrame:
    """Evidence without the citations whose entry changed its match or status."""
    stale = citations.join(changed_refs.select("doc_id", F.col("ref_id").alias("reference")).distinct(), ["doc_id", "reference"], "left_semi")
    return evidence.join(stale.select("doc_id", "citation_id").distinct(), ["doc_id", "citation_id"], "left_anti")


def changed_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries whose matched work or status differs between two verification runs."""
    o = old.select("doc_id", "ref_id", F.col("work_id").alias("_w"), F.col("status").alias("_s"))
    joined = new.join(o, ["doc_id", "ref_id"], "left")
    return joined.where(~(F.col("work_id").eqNullSafe(F.col("_w")) & F.col("status").eqNullSafe(F.col("_s")))).select("doc_id", "ref_id")


def choose_output(results: DataFrame, selections: DataFrame) -> DataFrame:
    """Final text and HTML per entry: the user's draft, the accepted suggestion, or corrected/original.

    ``selections(ref_id, draft)``: a NULL draft accepts the suggestion as it is; a row whose
    text equals the suggestion keeps its italics.
    """
    picked = results.join(selections.select("ref_id", "draft", F.lit(True).alias("_picked")), "ref_id", "left")
    usable = F.coalesce(F.col("_picked"), F.lit(False)) & (F.col("status") == "review") & F.col("suggested").isNotNull()
    draft = F.coalesce(F.nullif(clean_ws(F.col("draft")), F.lit("")), F.col("suggested"))
    text = F.when(usable, draft).otherwise(F.col("corrected"))
    html = F.when(usable, F.when(draft == F.col("suggested"), F.col("suggested_html"))).otherwise(F.col("corrected_html"))
    return picked.select(*results.columns, text.alias("output"), F.coalesce(html, escape_html(text)).alias("output_html"))


def custom_reference(results: DataFrame, drafts: DataFrame) -> DataFrame:
    """Edited entries (1..4000 characters); italic phrases survive where the text keeps them."""
    text = clean_ws(F.col("draft"))
    rows = results.join(drafts.select("ref_id", "draft"), "ref_id").where((text != "") & (F.length(text) <= 4000))
    return rows.select("ref_id", text.alias("suggested"), italic_html(F.coalesce("suggested_html", "corrected_html"), text).alias("suggested_html"))


def restore_year_suffix(results: DataFrame, refs: DataFrame) -> DataFrame:
    """'(2020)' becomes '(2020a)' in the output texts of entries whose year has a suffix."""
    keyed = refs.select("ref_id", F.regexp_extract("year_key", "[0-9]([a-z])$", 1).alias("_sfx"))
    rows = results.join(keyed, "ref_id", "left")
    texts = {c: _suffix(F.col(c), F.col("matched_year"), F.col("_sfx")) for c in ("suggested", "suggested_html")}
    verified = {c: F.when(F.col("status") == "verified", _suffix(F.col(c), F.col("matched_year"), F.col("_sfx"))).otherwise(F.col(c))
                for c in ("corrected", "corrected_html")}
    out = {**texts, **verified}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in results.columns])


def override_context(citations: DataFrame, overrides: DataFrame) -> DataFrame:
    """User contexts of one to four sentences (at most 8000 characters) replace the extracted ones."""
    given = with_computed(overrides.select("doc_id", "citation_id", F.col("text").alias("_t")), _c=split_sentences(F.col("_t")))
    given = given.where((F.length("_t") <= 8000) & F.size("_c").between(1, 4)).drop("_t")
    rows = citations.join(given, ["doc_id", "citation_id"], "left")
    out = {"context": F.coalesce("_c", "context"), "sentence": F.coalesce(F.try_element_at("_c", F.lit(-1)), F.col("sentence"))}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in citations.columns])


def propagate_match(audited: DataFrame, matches: DataFrame) -> DataFrame:
    """Extend decisions to every unresolved citation with the same authors and year."""
    decided = audited.join(matches, ["doc_id", "citation_id"]).select("doc_id", "authors", "year_key", "ref_id").groupBy("doc_id", "authors", "year_key").agg(F.min("ref_id").alias("ref_id"))
    similar = audited.where(F.col("issue").isNotNull() & ~F.col("protected")).join(decided, ["doc_id", "authors", "year_key"]).select("doc_id", "citation_id", "ref_id")
    extra = similar.join(matches.select("doc_id", "citation_id"), ["doc_id", "citation_id"], "left_anti")
    return matches.select("doc_id", "citation_id", "ref_id").unionByName(extra)


def apply_manual_matches(audited: DataFrame, matches: DataFrame, refs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """User mappings override automatic ones; differing year or author becomes a patch group.

    Adds ``manual_patches`` (array) and replaces reference, candidates, issue and kind.
    """
    chosen = matches.join(refs.select("doc_id", "ref_id", F.col("authors").alias("_ra"), F.col("author").alias("_r1"), F.col("year_key").alias("_ry")), ["doc_id", "ref_id"])
    rows = audited.join(chosen.withColumnRenamed("ref_id", "_ref"), ["doc_id", "citation_id"], "left")
    rows = rows.join(paragraphs.select("doc_id", "paragraph_id", F.col("text").alias("_par")), ["doc_id", "paragraph_id"], "left")
    rows = with_computed(rows, _tr=is_turkish(F.col("_par")))
    tr, free = F.col("_tr"), ~F.col("protected")
    link = F.when(F.col("narrative"), F.when(tr, F.lit(" ve ")).otherwise(F.lit(" and "))).otherwise(F.lit(" & "))
    author = F.when(F.size("_ra") >= 3, F.concat("_r1", F.when(tr, " ve ark.").otherwise(" et al."))).otherwise(F.array_join("_ra", "\x01"))
    author = F.replace(author, F.lit("\x01"), link)
    year = F.when(F.col("_ry") == "n.d.", F.lit("t.y.")).otherwise(F.col("_ry"))
    patches = F.array_compact(F.array(
        F.when(free & (F.col("year_key") != F.col("_ry")), F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("original").alias("original"), year.alias("replacement"))),
        F.when(free & (F.col("author_text") != author), F.struct(F.col("author_start").alias("start"), F.col("author_end").alias("end"), F.col("author_text").alias("original"), author.alias("replacement")))))
    manual = F.col("_ref").isNotNull()
    rows = with_computed(rows, manual_patches=F.when(manual, patches))
    some = F.size("manual_patches") > 0
    issue = F.when(manual, F.when(some, F.lit(L.ISSUE_MANUAL)).when(F.col("protected"), F.lit(L.ISSUE_MANUAL_PROTECTED))).otherwise(F.col("issue"))
    out = {"reference": F.coalesce("_ref", "reference"), "candidate": F.when(~manual, F.col("candidate")), "issue": issue,
           "candidates": F.when(~manual, F.col("candidates")), "kind": F.when(manual, F.when(some, F.lit(L.ISSUE_MANUAL))).otherwise(F.col("kind")),
           "patch": F.when(manual, F.try_element_at("manual_patches", F.lit(1))).otherwise(F.col("patch"))}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in audited.columns], "manual_patches")


def refresh_result_links(base: DataFrame, effective: DataFrame, patches: DataFrame) -> DataFrame:
    """Citations of the original text joined to those of the edited text at the shifted offset.

    Anchors (id, offsets, original) stay; match, context and author text come from the edit.
    """
    cols = ("reference", "candidate", "candidates", "context", "sentence", "year_key", "issue", "kind", "text", "authors", "author_text", "author_key")
    delta = F.length("replacement") - (F.col("end") - F.col("start"))
    moved = patches.select("doc_id", "paragraph_id", F.col("start").alias("_ps"), delta.alias("_d"))
    shift = (base.select("doc_id", "paragraph_id", "citation_id", "start").join(moved, ["doc_id", "paragraph_id"]).where(F.col("_ps") < F.col("start"))
             .groupBy("doc_id", "citation_id").agg(F.sum("_d").cast("int").alias("_shift")))
    placed = base.join(shift, ["doc_id", "citation_id"], "left").withColumn("_at", F.col("start") + F.coalesce("_shift", F.lit(0)))
    now = effective.select("doc_id", "paragraph_id", F.col("start").alias("_at"), F.col("citation_id").alias("effective_id"), F.struct(*cols).alias("_e"))
    joined = placed.join(now, ["doc_id", "paragraph_id", "_at"], "left")
    hit = F.col("_e").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns],
                         F.coalesce("effective_id", "citation_id").alias("effective_id"))


def carry_matches(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """Accepted matches move to the edited paragraph's citations by (authors, year) in order."""
    def numbered(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("doc_id", "paragraph_id", "authors", "year_key").orderBy("start")
        return df.withColumn("_n", F.row_number().over(w))
    prior = numbered(old).join(matches, ["doc_id", "citation_id"]).select("doc_id", "paragraph_id", "authors", "year_key", "_n", "ref_id")
    return numbered(new).join(prior, ["doc_id", "paragraph_id", "authors", "year_key", "_n"]).select("doc_id", "citation_id", "ref_id")


def _renumber(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("_order")
    rows = rows.withColumn("pos", F.row_number().over(w) - 1)
    return with_identity(rows.select("doc_id", F.concat(F.lit("r"), F.col("pos").cast("string")).alias("ref_id"), "pos", "raw", "paragraphs", "protected"))


def merge_entries(refs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Join each decided entry with its successor; ids are renumbered."""
    flagged = refs.join(decisions.select("doc_id", "ref_id", F.lit(1).alias("_m")), ["doc_id", "ref_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = F.when(F.coalesce(F.lag("_m").over(w), F.lit(0)) == 1, 0).otherwise(1)
    grouped = flagged.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("doc_id", "_g").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "paragraphs"))).alias("x"), F.bool_or("protected").alias("protected"))
    return _renumber(merged.select("doc_id", F.col("_g").alias("_order"), F.array_join("x.raw", " ").alias("raw"), F.flatten("x.paragraphs").alias("paragraphs"), "protected"))


def split_entry(refs: DataFrame, decisions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Decided entries of several paragraphs become one entry per paragraph; ids are renumbered."""
    flagged = refs.join(decisions.select("doc_id", "ref_id", F.lit(True).alias("_s")), ["doc_id", "ref_id"], "left")
    split = F.coalesce("_s", F.lit(False)) & (F.size("paragraphs") > 1)
    kept = flagged.where(~split).select("doc_id", F.struct("pos", F.lit(0).alias("n")).alias("_order"), "raw", "paragraphs", "protected")
    parts = flagged.where(split).select("doc_id", "pos", F.posexplode("paragraphs").alias("n", "paragraph_id"))
    par = paragraphs.select("doc_id", "paragraph_id", F.trim("text").alias("raw"), "protected")
    pieces = parts.join(par, ["doc_id", "paragraph_id"]).select("doc_id", F.struct("pos", "n").alias("_order"), "raw", F.array("paragraph_id").alias("paragraphs"), "protected")
    return _renumber(kept.unionByName(pieces))


def editable_paragraphs(paragraphs: DataFrame, refs: DataFrame, limits: DataFrame) -> DataFrame:
    """Body paragraphs that may be edited: unprotected, unlocked, no heading, outside the bibliography."""
    used = refs.select("doc_id", F.explode("paragraphs").alias("paragraph_id")).distinct()
    rows = paragraphs.where((F.col("part") == BODY) & (F.col("grp") == F.col("part")) & ~F.col("protected") & ~F.col("paragraph_locked")
                            & ~F.trim("text").rlike(BIB_HEADING))
    rows = rows.join(limits.select("doc_id", "start", "end"), "doc_id", "left")
    outside = ~F.coalesce(F.col("idx").between(F.col("start"), F.col("end")), F.lit(False))
    return rows.where(outside).drop("start", "end").join(used, ["doc_id", "paragraph_id"], "left_anti")


def dice_similarity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Character-bigram Dice of two texts (multisets), capped at 99; 100 if identical, NULL without ``b``.

    Bigram counts combine before the shuffle; no pair of texts is compared in one place.
    """
    x = with_computed(pairs.select(key, a, b), _a=composed_ws(F.col(a)), _b=composed_ws(F.col(b)))

    def grams(c: str, na: int, nb: int) -> DataFrame:
        n = F.length(c)
        index = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return x.select(key, F.explode(F.transform(index, lambda i: F.substring(F.col(c), i, F.lit(2)))).alias("g"), F.lit(na).alias("na"), F.lit(nb).alias("nb"))
    counts = grams("_a", 1, 0).unionByName(grams("_b", 0, 1)).groupBy(key, "g").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    overlap = counts.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("overlap"))
    rows = x.join(overlap, key, "left")
    total = F.greatest(F.lit(1), F.length("_a") + F.length("_b") - 2)
    score = F.least(F.lit(99), F.floor(F.lit(200) * F.coalesce("overlap", F.lit(0)) / total + 0.5)).cast("int")
    return rows.select(key, F.when(F.col("_b") == "", F.lit(None).cast("int")).when(F.col("_a") == F.col("_b"), 100).otherwise(score).alias("similarity"))


def composed_ws(c: Column) -> Column:
    """NFC and squeezed; only texts with combining or rare characters leave the JVM."""
    c = F.coalesce(c, F.lit(""))
    rare = nfc(F.when(c.rlike("[^\\x{0000}-\\x{024F}\\x{2010}-\\x{2022}]"), c))
    return clean_ws(F.coalesce(rare, c))
