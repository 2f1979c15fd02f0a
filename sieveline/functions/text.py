"""Column builders over text: tokenizers, the fact parser, prompts and bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words with inner hyphens or apostrophes, or one other character that is no space.
TOKEN = r"[\p{L}\p{N}_]+(?:[-'’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def regex_tokens(text: Column | str) -> Column:
    """Case-preserving tokens of TOKEN, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


#: Words that the Penn Treebank conventions write as two, in any case.
CONTRACTIONS = (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"), ("'t", "is"), ("'t", "was"))
_LETTER = r"[\p{L}\p{N}_]"


def treebank_tokens(text: Column | str) -> Column:
    """Tokens by the published Penn Treebank conventions, without splitting sentences; case-preserving, none for null.

    Opening double quotes become `` and closing ones ''; other quotation marks and
    punctuation stand alone, but for a comma or colon before a digit, which stays in its
    word. Two periods or more are one token. A single period is split off at the end of
    the text only, also before closing quotes and brackets. Clitics (it 's, ca n't,
    they 're), possessive apostrophes and the words in CONTRACTIONS (can not, gim me) are split.
    """
    col = F.col(text) if isinstance(text, str) else text
    out = F.coalesce(col, F.lit(""))
    opening = [("([«“‘„]|`+)", " $1 "), ('^"', "``"), ("``", " `` "), (r"([ (\[{<])(\"|'')", "$1 `` "), (rf"'((?![mtsdnMTSDN]){_LETTER})(?!{_LETTER})", "' $1")]
    marks = [
        (rf"([^.])(\.)([\])}}>\"'»”’ ]*){_SPACE}*$", "$1 $2 $3 "), (r"([:,])(\D)", " $1 $2"), ("([:,])$", " $1 "), (r"\.{2,}", " $0 "), (r"[;@#$%&?!*]", " $0 "), ("([^'])' ", "$1 ' "),
        (r"[\]\[(){}<>]", " $0 "), ("--", " -- "),
    ]
    for pattern, to in opening + marks:
        out = F.regexp_replace(out, pattern, to)
    # what comes last looks for the space behind a word
    out = F.concat(F.lit(" "), out, F.lit(" "))
    closing = [("([»”’])", " $1 "), ("''", " '' "), ('"', " '' "), ("([^' ])('[sSmMdD]|') ", "$1 $2 "), ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 ")]
    firsts, whole = "|".join(dict.fromkeys(a for a, _ in CONTRACTIONS)), "|".join(a + b for a, b in CONTRACTIONS)
    for pattern, to in [*closing, (rf"(?i)(?<!{_LETTER})(?=(?:{whole})(?!{_LETTER}))({firsts})", " $1 ")]:
        out = F.regexp_replace(out, pattern, to)
    return F.filter(F.split(out, f"{_SPACE}+"), lambda t: t != "")


TOKENIZERS: dict[str, Callable[[Column | str], Column]] = {"regex": regex_tokens, "treebank": treebank_tokens}


def tokens(text: Column | str, tokenizer: str = "regex") -> Column:
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"Unknown tokenizer {tokenizer!r}; known: {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[tokenizer](text)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def _drop_and(c: Column) -> Column:
    return _strip(F.regexp_replace(c, r"^(?i:and )", ""))


def likes(text: Column | str) -> Column:
    """Attributes that a sentence states: what follows the first ``likes``, split at commas.

    Trailing periods go. The last of several items is split at " and " as well; one item
    alone is never split. A leading "and " goes. Distinct, in order; none for null.
    """
    col = F.col(text) if isinstance(text, str) else text
    items = F.split(_strip(F.substr(col, F.instr(col, "likes") + 5)), ",")
    clean = F.transform(items, lambda x: F.regexp_replace(_strip(x), r"\.+$", ""))
    last = F.size(clean) - 1
    parts = F.transform(clean, lambda x, i: F.when((last > 0) & (i == last) & x.contains(" and "), F.split(x, " and ")).otherwise(F.array(x)))
    found = F.filter(F.transform(F.flatten(parts), lambda x: _drop_and(_strip(x))), lambda x: x != "")
    return F.when(F.instr(col, "likes") > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def gold_size_bin(size: Column | str) -> Column:
    size = F.col(size) if isinstance(size, str) else size
    out = None
    for most, label in ((2, "01-02"), (5, "03-05"), (20, "06-20"), (50, "21-50"), (100, "51-100")):
        out = F.when(size <= most, label) if out is None else out.when(size <= most, label)
    return out.otherwise("101-200")


def rerank_prompt(instruction: str, query: Column | str, document: Column | str) -> Column:
    """The text that a pair scorer reads."""
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), document)


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Equal within a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
