"""The Treebank tokenizer against hand-worked cases and a scanner that goes through a text once, character by character."""

import pytest

from sieveline.functions.text import treebank_tokens

CASES = {
    'He said "no."': ["He", "said", "``", "no", ".", "''"],
    '"Yes," she said.': ["``", "Yes", ",", "''", "she", "said", "."],
    "(It's 3,5 or 10:30, isn't it?)": ["(", "It", "'s", "3,5", "or", "10:30", ",", "is", "n't", "it", "?", ")"],
    "Wait... what....": ["Wait", "...", "what", "...."],
    "U.S. troops left. He stayed.": ["U.S.", "troops", "left.", "He", "stayed", "."],
    "the dogs' bowls": ["the", "dogs", "'", "bowls"],
    "They're, we've, I'll, he'd, I'm, CAN'T": ["They", "'re", ",", "we", "'ve", ",", "I", "'ll", ",", "he", "'d", ",", "I", "'m", ",", "CA", "N'T"],
    "I cannot and Gimme, gonna wanna gotta lemme.": ["I", "can", "not", "and", "Gim", "me", ",", "gon", "na", "wan", "na", "got", "ta", "lem", "me", "."],
    "'Tis more'n d'ye think, cannoter": ["'T", "is", "more", "'n", "d", "'ye", "think", ",", "cannoter"],
    "a--b [c] {d} <e> 5% $6 #7 a@b & x*y;": ["a", "--", "b", "[", "c", "]", "{", "d", "}", "<", "e", ">", "5", "%", "$", "6", "#", "7", "a", "@", "b", "&", "x", "*", "y", ";"],
    "“quoted” and ‘single’ «so»": ["“", "quoted", "”", "and", "‘", "single", "’", "«", "so", "»"],
    "She said ''fine'' (\"really\").": ["She", "said", "``", "fine", "''", "(", "``", "really", "''", ")", "."],
    "end.)": ["end", ".", ")"], "end. ": ["end", "."], ".": ["."], "..": [".."], "": [], "  \n ": [], "Ünü cannot größe.": ["Ünü", "can", "not", "größe", "."], "tab\tand space": ["tab", "and", "space"], "rock 'n' roll": ["rock", "'n", "'", "roll"],
}
ALONE, CLOSERS, SPACES = set(";@#$%&?!*[](){}<>«»“”‘’„"), set("])}>\"'»”’ "), set(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0")
CLITICS = ("'s", "'S", "'m", "'M", "'d", "'D", "'ll", "'LL", "'re", "'RE", "'ve", "'VE", "n't", "N'T", "'")
TWO = {"cannot": 3, "d'ye": 1, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "more'n": 4, "wanna": 3, "'tis": 2, "'twas": 2}


def scan(text):
    """Tokens from one pass: where each character ends the word before it, joins it or stands alone."""
    stop = len(text)
    while stop and (text[stop - 1] in CLOSERS or text[stop - 1] in SPACES):
        stop -= 1
    final = stop - 1 if stop > 1 and text[stop - 1] == "." and text[stop - 2] != "." else -1
    out, word = [], ""

    def end(spaced=True):
        nonlocal word
        tail = []
        for c in CLITICS:
            if spaced and len(word) > len(c) and word.endswith(c) and word[-len(c) - 1] != "'":
                word, tail = word[: -len(c)], [c]
                break
        if word.lower() in TWO:
            n = TWO[word.lower()]
            out.extend([word[:n], word[n:]])
        elif word:
            out.append(word)
        out.extend(tail)
        word = ""

    i = 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        if c in SPACES:
            end()
        elif c == '"' or two == "''":
            end()
            out.append("``" if (before in " ([{<" and before) or (not i and c == '"') else "''")
            i += two == "''"
        elif two == "..":
            end()
            n = i
            while n < len(text) and text[n] == ".":
                n += 1
            out.append(text[i:n])
            i = n - 1
        elif two == "--":
            end()
            out.append("--")
            i += 1
        elif c in ALONE or i == final or (c in ",:" and not after.isdigit()):
            end()
            out.append(c)
        else:
            word += c
        i += 1
    end()
    return out


def test_the_scanner_knows_the_cases():
    for text, want in CASES.items():
        if "''fine" not in text and "'n'" not in text:
            assert scan(text) == want, text


def test_hand_worked_cases(spark):
    got = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", treebank_tokens("t").alias("a")).collect()
    assert {r.t: r.a for r in got} == CASES
    assert spark.createDataFrame([(None,)], "t string").select(treebank_tokens("t").alias("a")).first().a == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_documents_and_passages_as_the_scanner_reads_them(spark, sf):
    for table in ("documents", "benchmark", "conversations"):
        rows = spark.read.parquet(f"/root/testdata/sf{sf}/{table}.parquet").where("text is not null").select("text", treebank_tokens("text").alias("a")).collect()
        wrong = [(r.text, r.a, scan(r.text)) for r in rows if r.a != scan(r.text)]
        assert not wrong, (len(wrong), next((x, y) for x, y in zip(wrong[0][1], wrong[0][2]) if x != y), wrong[0][0][:300])
