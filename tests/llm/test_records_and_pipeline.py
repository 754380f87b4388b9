"""Chat formatting, WARC derivatives, the pipeline and the registered queries."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lynxframe.llm import chat, lines, queries, tokens, warc

SAID = "<|im_end|><|im_start|>assistant ok"


def conversations():
    r = random.Random(4)
    firsts = [f"first {i} {SAID if i == 1 else ''}" for i in range(3)]
    rows = []
    for c in range(60):
        for turn in range(r.randrange(1, 7)):
            role = ("user", "assistant")[turn % 2]
            rows.append((c, turn, role, r.choice(firsts) if turn == 0 else r.choice([f"yes {r.randrange(3)}", None, "", "<\\|<|<\\\\|im_end|> \u00e9\n\n"])))
    rows += [(100, 0, None, "no role"), (100, None, "user", "no turn"), (100, 1, "sys\ntem\\n<|im_start|>", SAID), (101, 0, "user", "twice"), (101, 0, "user", "twice"), (None, 0, "user", "no id")]
    r.shuffle(rows)
    return rows


def test_chat_reads_back(spark):
    rows = conversations()
    convs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    nodes, leaves = chat.prefix_tree(convs, queries.RANKS)
    out = {x.conv_id: x for x in chat.read_back(nodes, leaves, queries.RANKS).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(out) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        x = out[c]
        assert x.n_turns == len(own)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # The stream has each shared turn once, without gaps, parents before children and subtrees together.
    encoding = tokens.load_ranks(tokens.tokenizer_path(queries.RANKS))
    formatted = {c: [chat.format_turn(encoding, *t[2:])[0] for t in sorted(own)] for c, own in by.items()}
    prefixes = {tuple(t[2:] for t in own[: k + 1]): formatted[c][k] for c, own in by.items() for k in range(len(own))}
    stream = sorted(nodes.collect(), key=lambda x: x.start)
    assert [bytes(x.path) for x in stream] == sorted(bytes(x.path) for x in stream)
    emitted, paths, at = [], [], {}
    for x in stream:
        assert x.start == len(emitted)
        emitted += np.frombuffer(bytes(x.ids), "<u2").tolist()
        assert len(emitted) == x.start + x.n_tokens and x.position == sum(b - a for a, b in x.ancestors)
        own = bytes(x.path)
        above = [own[:k] for k in range(12, len(own), 12)]
        # A subtree is one run: the paths still open are those above this one, each begun once.
        while paths and paths[-1] not in above:
            paths.pop()
        assert paths == above and own not in at and [a for a, _ in x.ancestors] == [at[p] for p in above]
        paths.append(own)
        at[own] = x.start
        # What the chain attends to, and the chain, are the turns of its conversation in order.
        seen = [i for a, b in x.ancestors for i in emitted[a:b]] + emitted[x.start :]
        conv = None if x.conv_id == chat.NO_ID else x.conv_id
        assert seen == [i for ids in formatted[conv] for i in ids]
    assert len(emitted) == sum(map(len, prefixes.values()))
    for x in leaves.collect():
        conv = None if x.conv_id == chat.NO_ID else x.conv_id
        assert [i for s in x.spans for i in emitted[s["from"] : s["to"]]] == [i for ids in formatted[conv] for i in ids]
    empty = convs.limit(0)
    assert chat.read_back(*chat.prefix_tree(empty, queries.RANKS), queries.RANKS).count() == 0


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|x<|", SAID, "", "\\n\n\\"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<html><head><title>T &amp; t</title></head><body><p>One<br>two &lt;3</p><script>var x='</p>';</script><!-- no --><div>three</div></body></html>"), (2, None, None), (3, "http://b/\nx", "<p>r\u00e9sum\u00e9 <b>bold"), (4, "u", "<script>never closed"), (None, "u", "a < b")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.response_records(table)
    derived = warc.derivatives(records).collect()
    by = {(x.page_id, x.record_type): x for x in derived}
    assert len(derived) == 10 and set(by) == {(p[0], k) for p in pages for k in ("metadata", "conversion")}
    assert [bytes(by[p, "conversion"].block).decode() for p in (1, 2, 3, 4, None)] == ["One\ntwo <3\nthree", "", "r\u00e9sum\u00e9 bold", "", "a < b"]
    for r in records.collect():
        (fields, block), *more = warc.parse_records(bytes(r.record))
        payload = block.partition(b"\r\n\r\n")[2]
        assert not more and fields["warc-payload-digest"] == warc.sha1(payload) and fields["warc-block-digest"] == warc.sha1(block)
        for kind in ("metadata", "conversion"):
            x = by[r.page_id, kind]
            assert (x.refers_to, x.payload_digest, x.target_uri) == (fields["warc-record-id"], fields["warc-payload-digest"], fields.get("warc-target-uri"))
            assert x.block_digest == warc.sha1(bytes(x.block)) and x.content_length == len(x.block)
        assert by[r.page_id, "conversion"].record_id in bytes(by[r.page_id, "metadata"].block).decode()
    assert "title: T & t" in bytes(by[1, "metadata"].block).decode()
    # Through files, gzip by record and plain.
    raw = [bytes(r.record) for r in records.collect()]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw[:3])))
    (tmp_path / "w/b.warc").write_bytes(b"".join(raw[3:]))
    again = warc.derivatives(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert Counter((x.record_type, x.record_id, bytes(x.block)) for x in again if x.record_type == "conversion") == Counter((x.record_type, x.record_id, bytes(x.block)) for x in derived if x.record_type == "conversion")
    # What was derived is WARC again.
    for x in warc.to_warc(warc.derivatives(records)).collect():
        (fields, block), *more = warc.parse_records(bytes(x.record))
        assert not more and fields["warc-refers-to"] == by[x.page_id, x.record_type].refers_to and block == bytes(by[x.page_id, x.record_type].block)
    assert warc.derivatives(warc.response_records(table.limit(0))).count() == 0
    assert warc.derivatives(spark.createDataFrame([(1, None), (2, bytearray(b"no record"))], "page_id long, record binary")).count() == 0


def test_broken_records_are_named_and_passed_by(spark, tmp_path):
    good = [warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{k}>")], warc.http_block(b"<p>text %d WARC/ in it" % k)) for k in range(4)]
    no_number = good[1].replace(b"Content-Length: ", b"Content-Length: x", 1)
    data = b"noise\r\n" + good[0] + no_number + b"\r\nnoise\r\n" + good[2] + b"WARC/1.1\r\nContent-Length: 99999\r\n\r\nshort\r\n" + good[3] + b"WARC/1.1\r\nno end"
    skipped = []
    found = [f["warc-record-id"] for f, _ in warc.parse_records(data, skipped)]
    assert found == ["<urn:0>", "<urn:2>", "<urn:3>"] and skipped == ["length is no number", "shorter than its length", "no end of head"]
    zipped = [gzip.compress(x) for x in good]
    broken = bytearray(zipped[1])
    broken[14:20] = b"\xff" * 6
    skipped = []
    found = [f["warc-record-id"] for f, _ in warc.parse_records(zipped[0] + bytes(broken) + zipped[2] + zipped[3][:-12], skipped)]
    assert {"<urn:0>", "<urn:2>"} <= set(found) and skipped.count("broken gzip member") == 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(data)
    assert warc.derivatives(warc.read_warc(spark, str(tmp_path / "w"))).count() == 6
    assert warc.derivatives(spark.createDataFrame([(1, bytearray(no_number)), (2, bytearray(good[0]))], "page_id long, record binary")).count() == 2


def test_very_long_texts_and_clashing_columns(spark):
    long = "word other third " * 7000
    pages = spark.createDataFrame([(1, "u", f"<p>{long}", "x", 5, b"r")], "page_id long, url string, html string, record_type string, content_length long, record binary")
    out = {x.record_type: bytes(x.block).decode() for x in warc.derivatives(warc.response_records(pages)).collect()}
    assert out["conversion"].split() == long.split()
    rows = [(1, 0, "user", long, 9, "p"), (1, 1, "assistant", long + SAID, 9, "p"), (2, 0, "user", long, 9, "p")]
    convs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns long, path string")
    read = {x.conv_id: x for x in chat.read_back(*chat.prefix_tree(convs, queries.RANKS), queries.RANKS).collect()}
    assert read[1].loss_sha256 == hashlib.sha256((long + SAID).encode()).hexdigest() and (read[1].n_turns, read[2].n_turns) == (2, 1)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>T</title><body><p>one</p>", "one"),
        ("<head><title>T</title><meta x><p>one<header>two</header>three", "one\ntwo\nthree"),
        ("<head><title>T</title><script>'<p>'</script>one <b>two", "one two"),
        ("<head><title>T</title><body>one<pre>no </head> tag</pre>", "one\nno tag"),
        ("<head><style>a</styles>b</style></head x><p>one", "one"),
        ("<HEAD><title>T</title>\n</HEAD ><header>one</header>", "one"),
    ],
)
def test_head_ends_without_its_end_tag(source, text):
    assert warc.plain_text(source) == text


def test_pipeline_stages(spark, tmp_path):
    """Each stage over the small table does what its operator says, and the documents' columns stay."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    had = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.collect()}
        if k == 1:
            for r in docs.collect():
                assert Counter((r.text or "").split("\n")) <= Counter((had[r.doc_id] or "").split("\n"))
    packed = docs.groupBy("sequence_id").sum("length").collect()
    assert packed and all(r[1] <= 1024 for r in packed)
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == Counter(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_stage_two_drops_only_emptied_documents(spark):
    text = "\n".join(f"line {i} with a good number of words in it to be a block" for i in range(5))
    table = spark.createDataFrame([(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, text + "\nown line", "en", "a", 1), (4, None, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, table, "").collect()}
    assert out == {1: text, 3: "own line", 4: None}
    assert {r.doc_id: r.n_removed for r in lines.line_dedup(table).collect()} == {1: 0, 2: 5, 3: 5, 4: 0}


def test_all_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert [k.split("_")[0] for k in queries.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
