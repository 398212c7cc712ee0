import hashlib
from collections import Counter, defaultdict

from helpers import SCHEMA, rows, table

from sagaledger.llm import alignment
from sagaledger.llm.queries import vocabulary

A, B = vocabulary(), vocabulary("piece_bpe_32k.model")
MORE = ["a▁b", " two  spaces ", "<|endoftext|> x", "<s> y </s>", "日本語 テスト 😛", "don't we'll x'lly", "tab\there \n\n  z", "ﬁ ｆｕｌｌ", "\x00 nul", "naïve café" * 40]


def tokenised(texts):
    """(A ids, A bytes, B ids, B bytes) of texts, from the libraries alone; None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = a_lib.encode(whole.decode(), add_special_tokens=False).ids, b_lib.encode(text or "")
        a_bytes = [bytes(byte_of[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        yield (a, a_bytes, b, b_bytes) if text and b"".join(a_bytes) == whole == b"".join(b_bytes) else None


def brute(texts):
    def spans(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    found = []
    for got in tokenised(texts):
        if got is None:
            found.append(None)
            continue
        a, sa, b, sb = got[0], spans(got[1]), got[2], spans(got[3])
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if s < v and u < e]
        groups, low = [], 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            groups.append(",".join(str(a[i]) for i, (_, e) in enumerate(sa) if low < e <= cut) + "|" + ",".join(str(b[j]) for j, (_, e) in enumerate(sb) if low < e <= cut))
            low = cut
        found.append((len(a), len(b), groups, links))
    count, best = Counter(), defaultdict(int)
    for got in found:
        count.update(set(got[3]) if got else ())
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if g is None else (g[0], g[1], len(g[2]), len(g[3]), sum(count[p] == best[p[0]] for p in g[3]), sum(count[p] for p in g[3]), hashlib.sha256(";".join(g[2]).encode()).hexdigest()) for g in found]


def test_alignment_equals_brute_force(spark):
    own = [(1000 + i, t, "en", "s", None, *["x", 1, *["x"] * 5]) for i, t in enumerate(MORE)]
    data = [r for r in rows(n=12) if r[1] is None or len(r[1]) < 3000] + own
    docs = spark.createDataFrame(data, SCHEMA)
    got = alignment.align(docs, A, B).collect()
    want = sorted((str(r[0]), *w) for r, w in zip(data, brute([r[1] for r in data])))
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_pairs_shared_by_all_documents_are_joined_with_the_rest(spark, monkeypatch):
    from sagaledger.llm import _frames

    docs = spark.createDataFrame([(i, "the same words of all and " + "xyzzy " * (i % 7) + str(i)) for i in range(60)], "doc_id bigint, text string")
    whole = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    monkeypatch.setattr(_frames, "HOT_ROWS", 5)
    monkeypatch.setattr(_frames, "HOT", 100)
    assert {r.doc_id: r for r in alignment.align(docs, A, B).collect()} == whole


def test_one_side_is_empty_or_long(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    long = table(spark, n=3).limit(0).unionByName(spark.createDataFrame([(1, "abc " * 30000, *[None] * 10)], SCHEMA))
    (r,) = alignment.align(long, A, B).collect()
    assert r.n_links == r.n_a + r.n_b - r.n_groups


def test_only_ends_of_one_side_are_looked_at_one_by_one(spark):
    """What lambdas walk are the ends that one side alone has; groups of one token of either side are taken by runs."""
    texts = ["the and of to in", "naïve café 日本 the of", "", None, "xyzzy", "the of xyzzyqq and in"]
    found = alignment.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), A, B)
    got = {r.doc_id: r for r in alignment.with_runs(alignment.with_odd(found)).collect()}
    for i, t in enumerate(tokenised(texts)):
        r, ends = got[i], [set() if t is None else {sum(map(len, side[:k + 1])) for k in range(len(side))} for side in (t or [()] * 4)[1::2]]
        assert r.n_shared == len(ends[0] & ends[1]) and len(r.odd) == len(ends[0] ^ ends[1])
        assert sum(x.n for x in r.runs) + len(r.groups) == r.n_shared
    assert got[0].odd == [] and got[5].odd != []


def test_units_of_a_text_have_its_tokens():
    """Ids by units that are shared among texts are those of the libraries on whole texts, also with odd white space."""
    import pyarrow as pa

    made = alignment.BothTokens(A, B)
    ends = ["word", "word.", "two\nlines", "a\n\nb", "x \n y", " lead", "trail ", "line\n", "\nline", "tab\tx y", "a  b", "no break here", "far　space so", "it's we'll", "▁mark a", "", "日本 語", "\x1c sep x", "café crème\nbrûlée", "<s> </s>\n<|endoftext|>"]
    texts = [*ends, *(f"{x} {y}" for x in ends for y in ends), *(f"{x}\n{y}" for x in ends for y in ends)]
    (a_ids, a_at), (b_ids, b_at) = made.both(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
    for k, want in enumerate(tokenised(texts)):
        got = a_ids[a_at[k] : a_at[k + 1]].tolist(), b_ids[b_at[k] : b_at[k + 1]].tolist()
        assert got == (([], []) if want is None else (want[0], want[2])), texts[k]
    assert made.cuts and len(made.slots) < sum(len(t.split()) for t in texts)
