"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar says which neighbouring characters have a unit's end between
them.  It becomes one zero-width regular expression, a lookbehind for the class
on the left and a lookahead for that on the right, so Spark's ``split`` cuts a
text there and keeps every character: joined, the pieces are the text again.
The cuts come from a hash of seed and id, so reruns agree, and the result is
one projection: no shuffle, and no more than one text's pieces at a time.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``, ``plain`` the text as it is.

Edge cases: null texts are taken as empty; empty ones have no units (``split``
alone would give one empty piece) and are plain; a text that holds a mark is
plain, so the marks of an output are its only ones and the text can be rebuilt;
a null id is hashed as the word null; rows are made one by one, repeated ones
alike; columns are kept whatever their names, but for one that has the name of
a result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bound

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: The order of the parts in each form.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Percent of documents that are transformed, and of those the share in the form spm.
TRANSFORMED, SPM = 90, 20
RESULTS = ("n_units", "form", "output", "prefix_chars", "middle_chars")

#: Any character (``\\P{Cs}``: all but the lone surrogates that Java sees inside a pair, which no valid text holds).
ANY_BEFORE, ANY_AFTER = r".", r"\P{Cs}"
#: Unit grammars: (class of the last character of a unit, class of the first character of the next one).
UNITS = {
    "code_point": [(ANY_BEFORE, ANY_AFTER)],
    "word": [(r"\s", r"\S")],
    "line": [(r"\n", ANY_AFTER)],
    "run": [(r"\w", r"\W"), (r"\W", r"\w")],
    "sentence": [(r"[.!?\u3002\uff01\uff1f]", r"\s")],
}


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width expression between the units of a grammar (Java syntax).

    Java walks over UTF-16 units; a place inside a surrogate pair, which looks
    ahead at a lone surrogate, is no boundary.
    """
    pairs = UNITS[grammar] if isinstance(grammar, str) else grammar
    ahead = lambda right: f"(?={ANY_AFTER})" + ("" if right == ANY_AFTER else f"(?={right})")
    return "(?s)" + "|".join(f"(?<={left}){ahead(right)}" for left, right in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "code_point") -> Column:
    """The units of a text, in order; none of an empty one."""
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def numbers(id_col: Column, seed: int = 1) -> Column:
    """array<long>: four unsigned 32-bit numbers from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def has_mark(text: Column) -> Column:
    return F.contains(text, F.lit(MARKS["prefix"])) | F.contains(text, F.lit(MARKS["suffix"])) | F.contains(text, F.lit(MARKS["middle"]))


def parts(text: Column, low: Column, high: Column, grammar: str | list[tuple[str, str]] = "code_point") -> Column:
    """struct(n, prefix, middle, suffix): a text cut behind the unit of each random number, modulo the number of cuts.

    The pieces are bound in a lambda, so ``split`` runs once for a text.
    """

    def cut(p: Column) -> Column:
        n = F.size(p).cast("long")
        joined = lambda start, count: F.array_join(F.slice(p, start, count), "")
        made = lambda c: F.struct(
            n.alias("n"), joined(F.lit(1), c[0]).alias("prefix"), joined(c[0] + 1, c[1] - c[0]).alias("middle"), joined(c[1] + 1, F.size(p) - c[1]).alias("suffix")
        )
        return bound(F.array_sort(F.array((low % (n + 1)).cast("int"), (high % (n + 1)).cast("int"))), made)

    return bound(units(text, grammar), cut)


def arranged(form: Column, cut: Column, text: Column) -> Column:
    """The output text of a form."""
    made = lambda order: F.concat(*[x for name in order for x in (F.lit(MARKS[name]), cut[name])])
    return F.when(form == "psm", made(FORMS["psm"])).when(form == "spm", made(FORMS["spm"])).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: cut at its marks, put back in order."""
    marks = "|".join(MARKS.values())

    def back(name: str) -> Column:
        place = {part: k + 1 for k, part in enumerate(FORMS[name])}
        return bound(F.split(output, marks, -1), lambda p: F.concat(*[F.get(p, place[part]) for part in ("prefix", "middle", "suffix")]))

    return F.when(form == "psm", back("psm")).when(form == "spm", back("spm")).otherwise(output)


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: str | list[tuple[str, str]] = "code_point", seed: int = 1, transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """``docs`` with n_units (long), form, output, prefix_chars and middle_chars (long, null if plain)."""
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))

    def made(t: Column, h: Column) -> Column:
        plain = (F.length(t) == 0) | has_mark(t) | (h[2] % 100 >= transformed)
        form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")

        def result(x: Column) -> Column:
            length = lambda c: F.when(x["form"] != "plain", F.length(c).cast("long"))
            return F.struct(
                x["cut"]["n"].alias("n_units"), x["form"].alias("form"), arranged(x["form"], x["cut"], t).alias("output"),
                length(x["cut"]["prefix"]).alias("prefix_chars"), length(x["cut"]["middle"]).alias("middle_chars"),
            )

        return bound(F.struct(parts(t, h[0], h[1], grammar).alias("cut"), form.alias("form")), result)

    # The input's columns travel in one struct, so none of their names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    out = rows.select("row", bound(text, lambda t: bound(numbers(F.col("row").getField(id_col), seed), lambda h: made(t, h))).alias("made"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULTS], *[F.col("made").getField(c).alias(c) for c in RESULTS])
