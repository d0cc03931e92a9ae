import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siltworks.llm import balance
from siltworks.llm.tokens import tokenizer_path
from siltworks.llm.wordbpe import word_encoder

from .samples import awkward, documents

PATH = tokenizer_path(balance.TOKENIZER)
TOKENIZER = Tokenizer.from_file(PATH)
SIGNS = st.one_of(st.sampled_from([*" \n\t'sdéİȺȾǅß²½ªſµ1", "'LL", " 'Re", "\u0085", "\x1c", "　", "<|endoftext|>", "<|STARTOFTEXT|>", "é", "Σ"]), st.characters(exclude_categories=["Cs"]))


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(SIGNS, max_size=60).map("".join))
def test_encoder_equals_library(text):
    encode = word_encoder(PATH)
    assert np.frombuffer(encode(text), encode.dtype).tolist() == ids_of(text)[:-1].tolist()


def test_encoder_on_each_sign_alone():
    encode = word_encoder(PATH)
    for first in range(0, 0x2100, 64):
        for c in range(first, first + 64):
            for text in (chr(c), f"a{chr(c)}B 1{chr(c)}{chr(c)}'s"):
                assert np.frombuffer(encode(text), encode.dtype).tolist() == ids_of(text)[:-1].tolist(), hex(c)


def unrolled(plan, histogram):
    """(sequence, offset, length, document) of every piece of the plan."""
    out = []
    for length, n in histogram.items():
        for k in range(n):
            left, number = length, k
            while left:
                i = np.searchsorted(plan.at[left], number, "right") - 1
                taken = int(plan.taken[left][i])
                out.append((int(plan.sequence[left][i] + number - plan.at[left][i]), int(plan.offset[left][i]), taken, (length, k)))
                left, number = left - taken, int(plan.goes_on[left][i] + number - plan.at[left][i])
    return out


def check_sequences(pieces, size):
    """Gapless, full or a power of two; returns tokens by sequence."""
    by = defaultdict(list)
    for sequence, offset, length, *_ in pieces:
        by[sequence].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    return by


def one_by_one(histogram, size):
    """The same rule, a document and a sequence at a time."""
    sequences = [c for c, n in balance.capacities(sum(k * n for k, n in histogram.items()), size) for _ in range(n)]
    spent, used, todo, got = [0] * len(sequences), [0] * len(sequences), [], Counter()
    for length, n in histogram.items():
        todo += [-length] * n
    heapq.heapify(todo)
    while todo:
        length = -heapq.heappop(todo)
        fits = [i for i, c in enumerate(sequences) if c - used[i] >= length]
        i = min(fits or [i for i, c in enumerate(sequences) if c > used[i]], key=lambda i: (spent[i], i))
        taken = min(length, sequences[i] - used[i])
        if taken == length:
            spent[i] += balance.cost(length)
        else:
            heapq.heappush(todo, taken - length)
        used[i] += taken
        got[i, taken] += 1
    return got


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 6), max_size=10))
def test_plan_is_the_rule(histogram):
    pieces = unrolled(balance.plan(histogram, 32), histogram)
    check_sequences(pieces, 32)
    whole = Counter()
    for *_, length, doc in pieces:
        whole[doc] += length
    assert whole == {(length, k): length for length, n in histogram.items() for k in range(n)}
    by_rule = Counter()
    for (_, taken), n in one_by_one(histogram, 32).items():
        by_rule[taken] += n
    assert Counter(p[2] for p in pieces) == by_rule


def test_plan_does_not_grow_with_the_corpus():
    lengths = {k: 1 + 4_000_000 // (k * k) for k in range(1, 4097)}
    many = balance.plan({k: n * 1_000_000 for k, n in lengths.items()})
    few = balance.plan(lengths)
    entries = lambda p: sum(map(len, p.at.values()))
    assert entries(many) < 1.5 * entries(few) + 4096
    assert balance.plan({}).at == {}


def test_pack(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").union(awkward(spark).selectExpr("doc_id + 900000", "text"))
    packed = balance.pack_balanced(docs).cache()
    rows = packed.collect()
    by = check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    want = Counter()
    for doc, text in docs.collect():
        ids = ids_of(text)
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    own = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        own[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    got = Counter()
    for (doc, n), pieces in own.items():
        if doc is not None and doc != 900_004:
            ids = b"".join(p for _, p in sorted(pieces))
            assert len(ids) == 4 * n
            got[doc, n, zlib.crc32(ids)] += 1
    assert got == {k: v for k, v in want.items() if k[0] not in (None, 900_004)}
    assert sum(len(p) for p in own.values()) == len(rows)
    total = sum(k[1] * v for k, v in want.items())
    assert sum(n for x in by.values() for _, n in x) == total and len(by) <= total // 4096 + 12
    # most documents that fit stay whole, and costs differ less than those of first fit
    cut = {(r.doc_id, r.doc_tokens) for r in rows if r.length < r.doc_tokens <= 4096}
    assert len(cut) < 0.15 * docs.count()
    costs = [r.cost for r in balance.sequence_costs(packed, 0, 1).collect() if r.n_tokens == 4096]
    bins = []  # first fit, descending, of the same documents
    for n in sorted((min(4096, len(ids) - at) for ids in (ids_of(t) for _, t in docs.collect()) for at in range(0, len(ids), 4096)), reverse=True):
        if not (room := next((b for b in bins if b[0] >= n), None)):
            bins.append(room := [4096, 0])
        room[0] -= n
        room[1] += n * n
    assert np.std(costs) < np.std([b[1] for b in bins])


@pytest.mark.parametrize("size", [8, 64])
def test_small_sequences_and_odd_rows(spark, size):
    docs = awkward(spark)
    rows = balance.pack_balanced(docs, size=size).collect()
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], size)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for (t,) in docs.select("text").collect())
    assert balance.report(docs.limit(0)).collect() == []
