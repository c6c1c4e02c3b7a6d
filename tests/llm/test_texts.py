import json
import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from heddle.llm import bpe, mojibake, origin, packing, splitting

FOLDER = bpe.default_folder()
needs_tokenizer = pytest.mark.skipif(not os.path.exists(os.path.join(FOLDER, "byte_bpe_50k.json")), reason="no tokenizer files")


@needs_tokenizer
def test_bpe_equals_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "hello world", "a" * 3000, "ñandú 日本語 😀‍💻", "x\r\n\t y", "<|endoftext|>", "=" * 77 + "\n" * 9, "don't we'll", "\u0000\u0085\ufffd"]
    got = bpe.Encoder(FOLDER, "byte_bpe_50k").encode([*texts, None])
    assert [list(g) for g in got[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts] and len(got[-1]) == 0


@needs_tokenizer
def test_bpe_in_spark_round_trip(spark):
    rows = [(1, "hello world"), (1, "hello world"), (2, ""), (3, None), (4, "é" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    enc = bpe.encode(df, "doc_id", "text")
    assert sorted((r.doc_id, len(r.ids)) for r in enc.collect())[:4] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    back = sorted(tuple(r) for r in bpe.decode(enc, "doc_id", "ids").collect())
    assert back == sorted((i, t or "") for i, t in rows)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_packing_places_every_piece(spark):
    rnd = np.random.default_rng(0)
    sizes = [int(x) for x in rnd.integers(0, 300, 500)] + [100, 250, None, 0, 64] + [40] * 300
    df = spark.createDataFrame([(k, s, "x") for k, s in enumerate(sizes)], "doc_id long, n_tokens int, container_id string")
    got = packing.pack(df, capacity=100).collect()
    fill = {}
    for r in got:
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(s or 0 for s in sizes)
    bins: list[int] = []  # first fit decreasing, for comparison
    for s in sorted((x for n in sizes for x in ([100] * ((n or 0) // 100) + [(n or 0) % 100]) if x), reverse=True):
        at = next((k for k, b in enumerate(bins) if b + s <= 100), None)
        if at is None:
            bins.append(s)
        else:
            bins[at] += s
    assert sorted(fill) == list(range(len(fill))) and len(fill) <= 1.03 * len(bins)
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.start, r["size"]))
    assert all(sum(x for _, x in per[k]) == (s or 0) for k, s in enumerate(sizes))
    assert all(len(per[k]) == 1 for k, s in enumerate(sizes) if (s or 0) <= 100)
    assert packing.pack(df.limit(0), capacity=100).count() == 0


def test_least_squares_fits():
    hist = np.zeros(11, "int64")
    hist[[4, 6]] = 50, 50
    plan = packing.plan(hist, 10, 0)
    assert sum(p.repeats for p in plan) == 50


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n\t,;{}é日\ŕ"), max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_keep_every_character(text, limit, overlap):
    parts = splitting.split_text(text, limit, overlap)
    real = min(overlap, limit - 1)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(b - a <= limit for a, b in parts)
    assert all(y[0] == max(0, x[1] - real) and y[1] > x[1] for x, y in zip(parts, parts[1:]))


def test_split_items(spark):
    text = "\n".join(f"line {k}" for k in range(40))
    items = [("a", 0, text, False, 5, 44, 1), ("a", 0, text, False, 5, 44, 1), ("a", 1, "short", False, 45, 45, 1), ("a", 0, "s" * 90, True, None, None, 1), ("b", 0, None, False, 1, 1, 1), ("c", 0, "z" * 200, False, None, None, 1), ("d", 0, "", False, 1, 1, 1)]
    it = spark.createDataFrame(items, "node_id string, chunk_index int, text string, is_smart_content boolean, start_line int, end_line int, kind int")
    nodes = spark.createDataFrame([("a", "code"), ("a", "code"), ("b", "code"), ("c", "content")], "node_id string, content_type string")
    limits = spark.createDataFrame([("code", 100, 10), ("content", 80, 0), ("smart_content", 40, 0)], "kind string, max_chars int, overlap_chars int")
    got = splitting.renumber(splitting.split_items(it, nodes, limits)).collect()
    a = sorted((r for r in got if r.node_id == "a" and r.smart == 0), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in a] == list(range(len(a))) and a[-1].text == "short" and a[0].start_line == 5 and a[-2].end_line == 44
    lines = text.split("\n")
    for r in a[:-1]:
        assert r.text.split("\n")[0] in lines[r.start_line - 5] and len(r.text) <= 100
    assert all(r.start_line is None for r in got if r.smart or r.node_id == "c")
    assert "".join(r.text for r in sorted((r for r in got if r.node_id == "c"), key=lambda r: r.chunk_index)) == "z" * 200
    assert sum(r.oversized for r in got if r.node_id in ("b", "d")) == 0
    assert splitting.split_items(it.limit(0), nodes, limits).count() == 0


CLEAN = {
    "de": "Die Größe der Änderung hängt vom Schlüssel ab, prüfen Sie für später.",
    "fr": "Il faut créer le résumé généré avant de déplacer la clé à côté.",
    "ru": "Сначала проверьте журнал, потом обновите список и сохраните отчёт.",
    "pl": "Ścieżka do węzła może być dłuższa niż myśleliśmy, zwróć błąd.",
    "ja": "古い索引は次回の実行時に削除されます。設定を読み込んでから更新します。",
}


FOREIGN = """Příliš žluťoučký kůň úpěl ďábelské ódy, když se vrátil domů
Пошук повертає результати для кожного вузла, якщо його індекс існує
Sökningen återger varje nod även när sökvägen är för lång för gränssnittet
Søgningen går gennem alle filer og gemmer nøglen på den rigtige måde
A keresés időben visszaadja az összes fájlt, és a gyűjtő őrzi a kulcsot
Căutarea întoarce fiecare nod și așteaptă până când fișierul este închis
Aramanın sonucu boşsa düğüm güncellenmiş özetle birlikte döndürülür
Η αναζήτηση επιστρέφει κάθε κόμβο όταν το αρχείο είναι κλειστό
Haku palauttaa jokaisen solmun myös silloin, kun tiedosto on jäänyt auki päällä
Tìm kiếm trả về mọi nút khi tệp đã được đóng và chỉ mục vẫn còn
Vyhľadávanie vráti každý uzol, keď je súbor zatvorený a kľúč sa našiel
Търсенето връща всеки възел, когато файлът е затворен и ключът е намерен
Pretraživanje vraća svaki čvor kad je datoteka zatvorena, a ključ pronađen
搜索会返回每个节点，即使文件已经关闭，索引仍然存在
검색은 파일이 닫혀 있어도 모든 노드를 반환합니다
Leitin skilar öllum hnútum þó að skráin sé lokuð og lykillinn finnist ekki
Otsing tagastab iga sõlme, kui fail on suletud ja võti leitud, õige äär
├── src
└── файл.txt
Set\u00a0the\u00a0pending fence: § 5, 20 °C, ½ µs, ±3 → ok""".split("\n")


def _margins_and_model(lines):
    model = mojibake.Model(mojibake.count_table(lines).astype("uint32"))
    return model, mojibake.judge(lines, model)


def test_languages_outside_the_corpus_stay():
    lines = [f"{t} {k}" for k in range(40) for t in CLEAN.values()]
    model, margins = _margins_and_model(lines)
    assert mojibake.Repairer(model, margins).lines(FOREIGN) == {}
    # each language of the corpus, left out of it
    for lang, text in CLEAN.items():
        model, margins = _margins_and_model([x for x in lines if not x.startswith(text)])
        assert mojibake.Repairer(model, margins).lines([text]) == {}, lang


def test_every_line_counts_for_the_margins(spark):
    """More lines than were once drawn, in repeated rows of any order and length."""
    lines = sorted({f"{t} {chr(0xE0 + k % 23)}{k}" for k in range(650) for t in CLEAN.values()}) + ["é", "à" * 500]
    assert len(lines) > 3_100
    table = mojibake.count_table(lines)
    docs = spark.createDataFrame([("\n".join(lines[k : k + 50]),) for k in range(0, len(lines), 50)] * 2 + [(None,), ("",), ("plain",)], "text string")
    shared = spark.sparkContext.broadcast(table.astype("uint32"))
    assert mojibake.validate_margins(docs, shared) == mojibake.judge(lines, mojibake.Model(table.astype("uint32")))
    half = mojibake.judge(lines[::2], mojibake.Model(table.astype("uint32")))
    assert mojibake.validate_margins(docs.limit(0), shared) == mojibake.judge([], mojibake.Model(table.astype("uint32"))) != half


def test_passages_among_intact_signs():
    model, margins = _margins_and_model([f"{t} {k}" for k in range(60) for t in (CLEAN["fr"], "Nous préférons l’étape : c’est plus sûr.", "L’œuvre voilà une étape.")])
    got = mojibake.Repairer(model, margins).lines(["Nous prΘfΘrons l’Θtape : c’est plus s√r.", "Nous prÈfÈrons l’Ètape : c’est plus s˚r."])
    assert [r.text for r in got.values()] == ["Nous préférons l’étape : c’est plus sûr."] * 2


def test_garbled_texts(spark):
    rows = [(k, t) for k, t in enumerate(list(CLEAN.values()) * 30)]
    bad, n = [], 1000
    for lang, read, written in [("de", "cp1252", "utf-8"), ("fr", "mac-roman", "utf-8"), ("ru", "cp1251", "koi8-r"), ("ru", "cp1252", "cp1251"), ("pl", "cp1250", "utf-8"), ("ja", "cp1252", "cp932"), ("fr", "cp437", "cp1252")]:
        g = mojibake.garble(CLEAN[lang], read, written)
        if g is not None:
            bad.append((n, g, CLEAN[lang]))
            n += 1
    twice = mojibake.garble(mojibake.garble(CLEAN["de"], "cp1252", "utf-8"), "cp1252", "utf-8")
    bad.append((n, twice, CLEAN["de"]))
    other = [(5000, "The report prints Ã¼ where the source file has ü; the file is fine."), (5001, None), (5002, ""), (5003, "plain ascii"), (5004, "na�ve and gar�on")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + [(i, g) for i, g, _ in bad] + other], "doc_id long, text string, restored string")
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert set(got) == {i for i, _, _ in bad} | {5004}
    assert [i for i, _, want in bad if got[i].restored != want] == []
    assert not got[5004].recoverable
    assert mojibake.repair(df.limit(0)).count() == 0


def test_garbled_invisible_characters(spark):
    fr = CLEAN["fr"]
    clean = [fr, "Nous préférons l’étape d’été à l’été passé, où l’élève a préparé la dernière épreuve.", "L’œuvre et l’été : « voilà » une dernière étape préférée."]
    bad = [
        (mojibake.garble("voilà : « étape »".replace(" ", "\xa0"), "cp1252", "utf-8"), "voilà : « étape »".replace(" ", "\xa0")),
        (mojibake.garble("une\xa0étape\xa0: oui\xa0; non", "latin-1", "utf-8"), "une\xa0étape\xa0: oui\xa0; non"),
        ("Prix\xc2\xa0: 40\xc2\xa0euros\xc2\xa0; net", "Prix\xa0: 40\xa0euros\xa0; net"),
        (mojibake.garble(mojibake.garble("passons à l'étape déjà préparée", "cp1252", "utf-8"), "cp1252", "utf-8"), "passons à l'étape déjà préparée"),
    ]
    rows = [(i, t) for i, t in enumerate(clean * 60)] + [(1000 + i, g) for i, (g, _) in enumerate(bad)]
    got = {r.doc_id: r.restored for r in mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string"), margins=mojibake.Margins()).collect()}
    assert got == {1000 + i: want for i, (_, want) in enumerate(bad)}


def test_origin(spark):
    hand = "import os\n\ndef read_block(path):\n    with open(path) as handle:\n        return handle.read()\n" * 4
    js = "export function mergeQueues(left, right) {\n  return left.concat(right);\n}\n" * 5
    mini = "".join(f"function a{chr(97 + k % 26)}(b,c){{return b?c.d({k}):null}}var e{k}={{f:{k},g:!0}};" for k in range(40))
    rows = [("r", f"r/src/m{k}.py", "python", hand + f"x{k} = 1\n") for k in range(6)] + [("r", f"r/src/m{k}.js", "javascript", js + f"const y{k} = 1;\n") for k in range(6)]
    rows += [
        ("r", "r/src/g.py", "python", "# Code generated by tool. DO NOT EDIT.\n" + hand), ("r", "r/src/banner.py", "python", 'BANNER = "Code generated by this tool. DO NOT EDIT."\n' + hand + "z = 2\n"),
        ("r", "r/vendor/x/i.py", "python", hand + "v = 1\n"), ("r", "r/src/vendors/i.py", "python", hand + "w = 1\n"), ("r", "r/static/s.js", "javascript", mini), ("r", "r/src/d.py", "python", "D = [\n" + "    1, 2, 3, 4, 250, 17, 99, 4,\n" * 40 + "]\n"),
        ("s", "s/src/copy.py", "python", hand + "x1 = 1\n"), ("r", "r/src/empty.py", "python", ""), ("r", "r/src/null.py", "python", None), ("r", "r/a_pb2.py", "python", None), ("r", "r/src/g.py", "python", None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "repo string, file_path string, language string, content string, kind int")
    kinds = {r.file_path: r.kind for r in origin.classify(df).collect()}
    assert {p: k for p, k in kinds.items() if k} == {"r/src/g.py": "generated", "r/vendor/x/i.py": "third_party", "r/static/s.js": "minified", "r/src/d.py": "data", "s/src/copy.py": "third_party", "r/src/m1.py": "third_party", "r/a_pb2.py": "generated"}
    assert origin.classify(df.limit(0)).count() == 0


def test_named_signals_mark_alone(spark):
    rnd = np.random.default_rng(5)
    word = lambda k: "".join(rnd.choice(list("bcdfgklmnprstaeiou"), 5))
    stems = ["read_block", "write_index", "merge_queue", "open_file", "close_handle", "find_node", "count_rows", "load_table", "store_value", "next_page"]
    rows = []
    for k in range(40):  # hand-written files in snake_case
        body = "".join(f"def {stems[(k + j) % 10]}_{word(j)}(path, limit):\n    total_rows = limit + {j}\n    return path, total_rows\n\n" for j in range(8))
        rows.append(("r", f"r/src/m{k}.py", "python", body))
    alphabet = list("qxzjkvwypbhgfdQXZJKVWYPBHGFD0123456789")
    rows.append(("r", "r/src/mangled.py", "python", "".join(f"    _{''.join(rnd.choice(alphabet, 7))} = {k}\n" for k in range(300))))
    rows.append(("r", "r/src/template.py", "python", "class Table:\n" + "".join(f"    field_{k} = column({k})\n" for k in range(300))))
    camel = "".join(f"def {s.split('_')[0]}{s.split('_')[1].title()}{word(k).title()}(pathName, rowLimit):\n    return pathName, rowLimit\n\n" for k, s in enumerate(stems * 3))
    rows.append(("r", "r/src/foreign.py", "python", camel))
    got = {r.file_path: r for r in origin.classify(spark.createDataFrame(rows, "repo string, file_path string, language string, content string")).collect() if r.kind}
    assert set(got) == {"r/src/mangled.py", "r/src/template.py", "r/src/foreign.py"}
    assert got["r/src/mangled.py"].minified == got["r/src/template.py"].generated == got["r/src/foreign.py"].third_party == 1.0


@needs_tokenizer
def test_merge_table_is_the_vocabulary():
    with open(os.path.join(FOLDER, "byte_bpe_50k.json"), encoding="utf-8") as f:
        n = len(json.load(f)["model"]["merges"])
    assert len(bpe._load(FOLDER, "byte_bpe_50k")[1]["rank"]) == n
