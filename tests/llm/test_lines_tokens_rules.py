import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import line_dedup, quality_rules
from tallyloom.llm.quality_rules import RULES, apply_rules, order_rules
from tallyloom.llm.queries import QUERIES
from tallyloom.llm.token_counts import count_tokens

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def expected_lines(docs, least=10):
    keys = lambda t: [ascii_lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    counts = Counter(k for _, t in docs for k in set(keys(t)) if k)
    out = []
    for i, t in docs:
        ks, lines = keys(t), (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if counts[k] < least or not k]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_line_dedup_both_ways(odd_docs):
    want = expected_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert any(x[2] for x in want)
    assert got_lines(line_dedup.dedup_lines(odd_docs)) == want
    assert got_lines(line_dedup.dedup_lines(odd_docs, broadcast_limit=0)) == want


def test_line_dedup_empty_table(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs, broadcast_limit=-1).count() == 0


def test_line_query(spark, small):
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in expected_lines([(r.doc_id, r.text) for r in small("documents").collect()])]
    assert rows(QUERIES["op3_line_dedup"](spark, SF), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_tokens_match_the_library(odd_docs, no_docs, small):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = odd_docs.select("doc_id", "text").unionByName(small("documents").select("doc_id", "text"))
    special = [(1, "<|endoftext|>"), (2, "a <|endoftext|>b  c \n d"), (3, "\x1c x\x85y  z　"), (4, "naïve 'll 've 12,5 😀😀 " * 20)]
    docs = docs.unionByName(odd_docs.sparkSession.createDataFrame(special, "doc_id long, text string"))
    for r in count_tokens(docs.withColumn("again", docs.text), path, limit=5).collect():
        text = r.again or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 5), repr(text[:80])
    assert count_tokens(no_docs, path).count() == 0


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_quality_rules(odd_docs, no_docs, small):
    docs = odd_docs.select("doc_id", "text").unionByName(small("documents").select("doc_id", "text"))
    got = apply_rules(docs.withColumn("again", docs.text)).collect()
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, again = want = base(r.again)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        text = r.again or ""
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        bad = 10 * symbols > n or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text)) or 2 * text.count("!") > n or 10 * dup > 4 * lines or not 3 * n <= chars <= 12 * n
        assert r.kept == (not r.base_failed and not bad)
    assert apply_rules(no_docs).count() == 0


def test_rule_order_is_a_permutation_and_does_not_change_the_verdict(odd_docs, small):
    docs = small("documents").select("doc_id", "text")
    assert sorted(r.name for r in order_rules(docs, "text", sample_rows=50)) == sorted(r.name for r in RULES)
    one = rows(apply_rules(docs, rules=RULES), "doc_id", "kept")
    assert one == rows(apply_rules(docs, rules=RULES[::-1]), "doc_id", "kept")


def test_cascade_by_what_earlier_rules_leave():
    # "b" rejects most, but nothing that "a" leaves; "c" rejects little, and others
    assert quality_rules.cascade(["a", "b", "c"], [1.0, 2.0, 1.0], {0b011: 100, 0b001: 5, 0b100: 3, 0: 50}) == [0, 2, 1]
    assert quality_rules.cascade(["y", "x"], [1.0, 1.0], {0: 9}) == [1, 0] and quality_rules.cascade(["y"], [0.0], {}) == [0]
