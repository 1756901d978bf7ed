import hashlib
import math
import re
import time
from statistics import NormalDist

import numpy as np
import pytest

from fleetgauge.llm import contamination, edit_counts, html_text, language, packing, personal_data, substrings
from fleetgauge.llm.labelled_pages import PAGES
from fleetgauge.llm.tokens import default_vocabulary, token_ids

SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


# ------------------------------------------------------------ tokens, packing


def test_ids_are_those_of_the_json_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    texts = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b", "\n\n x", "it's 'll", "<|endoftext|> a", "héé\u00a0ß 漢字 🙂", "1234 5.6"]
    ours = token_ids(default_vocabulary())
    for text in texts:
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_whole_and_tight(spark, empty):
    texts = [None, "", "a", "word " * 3000, *["some words here " * (i % 90) for i in range(300)]]
    rows = packing.pack(docs(spark, texts, n="x")).toPandas()
    encoder = token_ids(default_vocabulary())
    for i, text in enumerate(texts):
        own = rows[rows.doc_id == i].sort_values("piece")
        total = len(encoder.encode(text or "")) + 1
        assert own.length.sum() == total and (own.start == own.length.cumsum() - own.length).all()
        assert (own.length.iloc[1:] == 1024).all() and own.piece.tolist() == list(range(len(own)))
    rows = rows.sort_values(["sequence_id", "offset"])
    filled = rows.groupby("sequence_id").length
    assert (rows.offset == filled.cumsum() - rows.length).all() and filled.sum().max() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 1  # best fit is near the bound, not on it
    assert packing.pack(empty("doc_id long, text string")).collect() == []


def test_runs_are_those_of_best_fit_piece_by_piece():
    draw = np.random.default_rng(1)
    for _ in range(20):
        lengths = sorted(draw.integers(1, 40, 200).tolist(), reverse=True)
        gaps: list[int] = []
        for n in lengths:
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((fit if fit is not None else 40) - n)
        runs, sequences = packing.match_runs({n: lengths.count(n) for n in set(lengths)}, 40)
        assert sequences == len(gaps) and sum(r.count for r in runs) == 200


# ------------------------------------------------------------ edit-aware counts


def test_counts_follow_edits(spark, empty):
    draw = np.random.default_rng(2)
    encoder = token_ids(default_vocabulary())
    words = ["a", "it's", " ", "\n", "longer", "ééé", "12", "..", "\t", "  "]
    for _ in range(40):
        text = "".join(draw.choice(words, 200).tolist()).replace("longer", " longer ")
        tree = edit_counts.build_tree(text, encoder, 16)
        assert tree.total == encoder.count(text)
        for _ in range(12):
            start = int(draw.integers(0, len(text) + 3))
            stop = start + int(draw.integers(0, 30))
            text, tree, _ = edit_counts.edit(text, tree, start, stop, "".join(draw.choice(words, draw.integers(0, 60))), encoder, 16)
            tree = edit_counts.SegmentTree.from_bytes(tree.to_bytes())
            assert tree.total == encoder.count(text) and int(tree.sums[1, 0]) == len(text)
    texts = docs(spark, [None, "", "one two three four", "one two three four"])
    edits = spark.createDataFrame(
        [(1, 2, 0, 0, "b"), (1, 1, 0, 9, "a"), (2, 1, 4, 7, None), (0, 1, 0, 0, "x"), (None, 1, 0, 0, "x")],
        "doc_id long, seq int, start long, stop long, replacement string",
    )
    rows = edit_counts.with_trees(texts).join(edit_counts.gather_edits(edits), "doc_id", "left")
    found = {r.doc_id: r for r in edit_counts.apply_edits(rows).collect()}
    assert [found[i].text for i in range(4)] == [None, "ba", "one  three four", "one two three four"]
    assert all(found[i].n_tokens == encoder.count(found[i].text or "") for i in range(4))
    assert edit_counts.with_trees(empty("doc_id long, text string")).collect() == []


# ------------------------------------------------------------ language


def test_language_held_out_accuracy_and_odd_texts(spark, empty):
    table = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    model = language.train(language.training_sample(language.learnable(table)))
    odd = docs(spark, [None, "", "123 !!", "x" * 100_000], lang="zz").select("doc_id", "text", "lang")
    found = language.predict_languages(odd, model).collect()
    assert [r.lang_pred for r in found][:3] == ["und"] * 3 and found[3].lang_pred in model.languages
    judged = language.predict_languages(table, model).filter("held_out").join(table.select("doc_id", "lang"), "doc_id")
    rows = judged.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = language.identify_languages(empty("doc_id long, text string, lang string"))
    assert nothing.collect() == []
    alone = language.identify_languages(docs(spark, ["hallo"], lang="de")).collect()
    assert alone[0].lang_pred in ("de", "und")


# ------------------------------------------------------------ personal data


def plain_base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_agree_with_plain_patterns(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["a@b@c.d.e", "x.@y..z", "@a.b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111-1111 1111", "+1 (2) 3456789"]
    for text in texts:
        assert list(map(str, personal_data.base_spans(text))) == plain_base_spans(text)


def test_terms_that_give_an_entity_away(spark, empty):
    texts = [f"note {i} Zorblax wrote to jo@ex.org about the house" for i in range(6)]
    texts += [f"the house number {i} is about to be sold" for i in range(60)] + [None, "", "jo@ex.org"]
    found = {r.doc_id: r for r in personal_data.find_personal_data(docs(spark, texts, n="x")).collect()}
    assert all("zorblax" not in found[i].clean_text.lower() and "[EMAIL]" in found[i].clean_text for i in range(6))
    assert all("house" in found[i].clean_text for i in range(66)) and all(found[i].spans == "" for i in range(6, 66))
    assert found[66].clean_text is None and found[68].clean_text == "[EMAIL]"
    assert found[68].base_sha256 == hashlib.sha256(b"email:0:9").hexdigest()
    assert personal_data.find_personal_data(empty("doc_id long, text string")).collect() == []


# ------------------------------------------------------------ benchmark leaks


def test_wand_retrieves_what_scoring_every_item_does():
    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(draw.choice(words, 12))) for i in range(150)]
    index = contamination.Index(items)
    for _ in range(50):
        lists = sorted(set(draw.integers(0, len(index.lists), 40).tolist()))
        scores: dict[int, float] = {}
        for i in lists:
            for item, impact in zip(index.lists[i].items.tolist(), index.lists[i].impacts.tolist()):
                scores[item] = scores.get(item, 0.0) + impact
        for threshold in (0.05, 0.2, 0.4):
            found = dict(index.wand(lists, threshold))
            assert found == pytest.approx({k: v for k, v in scores.items() if v >= threshold})


def test_one_word_item_is_found_where_a_longer_item_shares_the_word():
    index = contamination.Index([(1, "alpha"), (2, "alpha beta gamma")])
    assert [h[0] for h in index.search("delta alpha beta delta", 0.5, 0.8)] == [1]
    assert [h[0] for h in index.search("alpha beta gamma", 0.5, 0.8)] == [1, 2]


def test_leaks_are_found_and_clean_texts_left(spark, empty):
    items = ["What is the name of the river near the town?\nThe river near the town is called Elm.", "one", None, "five short words are here"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    leak = "What is the name of the river near the town? The river near the town is called Elm."
    texts = [
        leak, f"{'x y z ' * 500} {leak.upper()} {'p q ' * 300}", "What is the name of the river near the town? No answer here.",
        None, "", "The One", "five short words are there", "so five short words are here now", leak,
    ]
    found = contamination.find_leaks(docs(spark, texts, n="x"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 0), (1, 0), (5, 1), (7, 3), (8, 0)]
    split = contamination.find_leaks(docs(spark, texts, n="x"), bench, per_part=1).collect()
    assert sorted((r.doc_id, r.item_id) for r in split) == [(0, 0), (1, 0), (5, 1), (7, 3), (8, 0)]
    assert contamination.find_leaks(empty("doc_id long, text string"), bench).collect() == []
    assert contamination.find_leaks(docs(spark, texts), bench.limit(0)).collect() == []


# ------------------------------------------------------------ repeated text


def test_repeats_go_and_first_ones_stay(spark, empty):
    line = "this line has quite a few words in it indeed"
    passage = " ".join(f"Sentence {i} of the passage, which is long enough to matter, says {i}." for i in range(8))
    texts = [
        f"{line}\nfirst words.", f"own words\n{line.upper()} \nmore own words", f"Intro here. {passage}", f"Other start. {passage} Other end.",
        None, "", "Yes. No.", "Yes. Never.", f"{line}\n{line}", "a" * 100_000,
    ]
    found = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts, first="x")).collect()}
    assert found[0].text == texts[0] and found[2].text == texts[2]
    assert found[1].text == "own words\nmore own words" and found[1].spans == f"10:{10 + len(line) + 1}"
    assert found[3].text == "Other start. Other end."
    assert [found[i].text for i in (4, 5, 6, 7)] == [None, "", "Yes. No.", "Yes. Never."]
    assert found[8].text == "" and found[9].n_removed == 0
    assert substrings.remove_repeats(empty("doc_id long, text string")).collect() == []
    same = spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id long, text string")
    assert len(substrings.remove_repeats(same).collect()) == 3


# ------------------------------------------------------------ main text of pages


def test_marginals_agree_with_enumeration():
    model = html_text.train_tree()
    dom = html_text.parse("<body><div class=ad><p>x</p></div><article><p>y</p><aside><p>z</p></aside></article></body>")
    n, kinds = len(dom.tags), dom.kinds()
    total, content = 0.0, np.zeros(n)
    for bits in range(1 << (n - 1)):
        labels = [0] + [bits >> i & 1 for i in range(n - 1)]
        log = 0.0
        for i in range(1, n):
            known = any(w in model.word for w in dom.words[i])
            edge = model.worded if known else model.child.get(kinds[i]) or model.child.get(dom.tags[i], model.unknown)
            log += edge[labels[dom.parents[i]]][labels[i]] + labels[i] * sum(model.word.get(w, 0.0) for w in dom.words[i])
        total += np.exp(log)
        content += np.exp(log) * np.array(labels)
    assert model.marginals(dom) == pytest.approx((content / total).tolist())


def test_main_text(spark, empty):
    model = html_text.train_tree()
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>x</a></li></ul></nav>"
        "<!-- c --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One\n  two<br>three<p>Four &copy 5</p><aside>no</aside>"
        "<div class='comments'><p>reader</p></div><form><p>q</p></form></article><footer>f</footer>"
    )
    assert html_text.main_text(page, model) == "A & B\n\nOne two three\n\nFour © 5"
    for labelled in PAGES:
        dom = html_text.parse(labelled)
        labels = [0] * len(dom.tags)
        for i in range(1, len(dom.tags)):
            labels[i] = int(dom.marks[i]) if dom.marks[i] else labels[dom.parents[i]]
        content = model.marginals(dom)
        wrong = [t for node, _, t in dom.texts if t.strip() and (content[node] > 0.5) != bool(labels[node])]
        assert len(wrong) <= 1, wrong
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", page, 1), (3, "u", page, 1), (4, "u", "<p>" * 500 + "<a href=\"x" + "y" * 9999, 1)]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.n_chars) for r in found][:4] == [(1, 0), (2, 0), (3, 30), (3, 30)]
    assert html_text.extract_text(empty("page_id long, url string, html string")).collect() == []


def test_addresses_with_very_long_parts_are_read():
    for part, found in (("9" * 5000, []), ("0" * 5000 + "7", ["ip:0:5007"]), ("0" * 5000, ["ip:0:5006"])):
        spans = personal_data.base_spans(f"1.2.3.{part}")
        assert [str(s) for s in spans if s.kind == "ip"] == found


def plain_terms(texts, disclosure, confidence):
    """Terms to generalise in each text, by counting every word with every entity."""
    z = NormalDist().inv_cdf(confidence)
    entities, words = [], []
    for text in texts:
        spans = personal_data.base_spans(text or "")
        entities.append({(s.kind, text[s.start : s.end]) for s in spans})
        rest = list(text or "")
        for s in spans:
            rest[s.start : s.end] = " " * (s.end - s.start)
        words.append(set(re.findall(r"\w+", "".join(rest).lower())))
    total, out = len(texts), [set() for _ in texts]
    for e in set().union(*entities):
        n_e = sum(e in own for own in entities)
        for t in set().union(*(w for own, w in zip(entities, words) if e in own)):
            n_t = sum(t in re.findall(r"\w+", (text or "").lower()) for text in texts)
            n_both = sum(e in own and t in w for own, w in zip(entities, words))
            p = n_both / n_t
            low = (p + z * z / 2 / n_t - z * math.sqrt(p * (1 - p) / n_t + (z / 2 / n_t) ** 2)) / (1 + z * z / n_t)
            bits = math.log(total / n_e)
            if n_both > 1 and bits > 0 and math.log(total * low / n_e) >= disclosure * bits:
                for own, w, terms in zip(entities, words, out):
                    terms |= {t} if e in own and t in w else set()
    return out


def test_disclosing_terms_agree_with_counting_all_words(spark):
    draw = np.random.default_rng(8)
    people = [f"p{i}@ex.org" for i in range(12)] + ["+49 170 1234567", "10.1.2.3"]
    texts = []
    for i in range(400):
        text = " ".join(f"w{int(300 * draw.random() ** 2)}" for _ in range(12))
        for k in draw.integers(0, len(people), int(draw.integers(0, 3))):
            # a word that nearly always stands with the entity, far from it, and one that the entity shares with others
            text = f"Alias{k} {text} {people[k]}" if draw.random() < 0.9 else f"{text} 77{k % 4} {people[k]}"
        texts.append(text)
    texts += [texts[0], None, "", "alias1 without", "lone@ex.org once"]
    for disclosure, confidence in ((0.9, 0.9), (0.6, 0.95)):
        expected = plain_terms(texts, disclosure, confidence)
        assert sum(map(len, expected)) > 50
        found = personal_data.find_personal_data(docs(spark, texts), disclosure, confidence).collect()
        for r in found:
            spans = [s.split(":") for s in r.spans.split(",") if s.startswith("term")]
            assert {texts[r.doc_id][int(b) : int(e)].lower() for _, b, e in spans} == expected[r.doc_id], r.doc_id


def test_long_runs_are_read_in_linear_time():
    many = " ".join(f"a{i}@ex.org word{i}" for i in range(10_000))
    for text in ("1" * 1_000_000, "1.2.3" + "4" * 1_000_000, "a" * 1_000_000 + "@", "a.b-" * 250_000 + "@@" * 1000, "a@" * 500_000, "+1" + " " * 1_000_000):
        begin = time.perf_counter()
        spans = personal_data.base_spans(text)
        assert not spans and time.perf_counter() - begin < 5, text[:20]
    begin = time.perf_counter()
    spans = personal_data.base_spans(many)
    assert len(spans) == 10_000 and len(list(personal_data.words_outside(many, spans))) == 10_000
    assert time.perf_counter() - begin < 5


def test_random_address_like_texts_agree_with_plain_patterns():
    draw = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(draw.choice(list("a1._-@+% é2"), 25, p=[0.2, 0.2, 0.2, 0.05, 0.05, 0.15, 0.03, 0.03, 0.03, 0.03, 0.03]))
        assert list(map(str, personal_data.base_spans(text))) == plain_base_spans(text), text


def test_repeated_passages_inside_other_text_are_found(spark):
    draw = np.random.default_rng(6)

    # so many words that none of the surroundings meets another by chance: a repeated piece at a passage's edge goes with it
    def words(n):
        return [f"v{int(x)}" for x in draw.integers(0, 10**9, n)]

    texts, planted = [], []
    for i in range(120):
        passage = words(50)
        if i % 2:
            passage[::7] = [w + "." for w in passage[::7]]
        for k in range(2):
            own = words(int(draw.integers(0, 80)))
            ahead, behind = " ".join(own), " ".join(words(int(draw.integers(0, 80))))
            # the second copy is cut into lines elsewhere and written in capitals
            inner = " ".join(passage) if not k else "\n".join([" ".join(passage[:21]), " ".join(passage[21:])]).upper()
            texts.append(f"{ahead} {inner} {behind}")
            planted.append((len(ahead) + 1, len(ahead) + 1 + len(inner)) if k else None)
    texts += [" ".join(words(400)) for _ in range(60)]
    found = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        spans = [tuple(map(int, s.split(":"))) for s in found[i].spans.split(",") if s]
        if i >= len(planted) or planted[i] is None:
            assert not spans
            continue
        begin, stop = planted[i]
        assert sum(len(text[b:e].split()) for b, e in spans) >= 20
        # nothing but the passage goes
        assert all(begin <= b and e <= stop + 1 for b, e in spans)


def test_units_agree_with_plain_hashing(spark):
    draw = np.random.default_rng(2)
    texts = ["\n".join(" ".join(f"x{int(w)}" for w in draw.integers(0, 3, int(draw.integers(0, 14)))) for _ in range(6)) for _ in range(60)]
    seen, kinds = {}, {}
    rows = []
    for i, text in enumerate(texts):
        units = substrings.Units(text)
        split = text.split()
        assert units.n_words == len(split) and units.n_lines == sum(bool(line.split()) for line in text.split("\n"))
        for place, (b, e) in enumerate(zip(units.begins, units.stops)):
            content = (place < units.n_lines, tuple(split[b:e]))
            assert kinds.setdefault(int(units.digests[place]), content) == content
            if content in seen:
                rows.append((i, place))
            seen.setdefault(content, (i, place))
        pieces = list(zip(units.begins, units.stops))[units.n_lines :]
        assert [w for b, e in pieces for w in split[b:e]] == split
    assert len(kinds) == len(seen)
    again = substrings.repeated_units(substrings.unit_rows(docs(spark, texts)))
    assert sorted(map(tuple, again.collect())) == rows


def test_repeats_without_blanks_and_with_text_ids(spark):
    line = "".join(chr(0x4E00 + 37 * i % 9000) for i in range(99))
    inside = "".join(chr(0x4E00 + 53 * i % 9000) for i in range(150))
    rows = [("a", line, 1), ("b", line, 1), ("c", f"前{inside}后", 1), ("d", f"甲乙{inside}右", 1), ("e", "短短短短短短短短短短", 1), ("f", "短短短短短短短短短短", 1)]
    found = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string, first int")).collect()}
    assert [found[k].n_removed for k in "abcdef"] == [0, 1, 0, 1, 0, 0]
    assert found["b"].text == "" and found["d"].text.startswith("甲乙") and len(found["d"].text) < 60
