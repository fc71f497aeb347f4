import json

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'x,y\n1,"two\nlines ""q"""\n,3\n')
    assert [tuple(r) for r in readers.csv(spark, path).collect()] == [("1", 'two\nlines "q"'), ("", "3")]
    assert readers.csv(spark, str(tmp_path / "none.csv"), ["x"], missing_ok=True).count() == 0
    with pytest.raises(Exception):
        readers.csv(spark, put(tmp_path, "b.csv", "x,y\n1,2,3\n"), ["x", "y"], strict=True).collect()


def test_tsv_and_metadata(spark, tmp_path):
    path = put(tmp_path, "a.hpoa", "#version: 2026\n#note: a:b\nid\tname\n1\tx\n\n#skip\n2\ty\n")
    assert [tuple(r) for r in readers.tsv_with_comments(spark, path).collect()] == [("1", "x"), ("2", "y")]
    assert {tuple(r) for r in readers.header_metadata(spark, path).collect()} == {("version", "2026"), ("note", "a:b")}


def test_obo(spark, tmp_path):
    path = put(tmp_path, "a.obo", "format-version: 1.2\n\n[Term]\nid: HP:1\nname: root\n\n[Term]\nid: HP:2\nname: leaf\nalt_id: HP:9\nis_a: HP:1 ! root\nis_a: HP:3 {x} ! other\n\n[Typedef]\nid: part_of\n\n[Term]\nid: HP:4\nis_obsolete: true\n")
    got = {r.id: r for r in readers.obo(spark, path).collect()}
    assert set(got) == {"HP:1", "HP:2", "HP:4"} and got["HP:2"].parents == ["HP:1", "HP:3"] and got["HP:2"].alt_ids == ["HP:9"] and got["HP:4"].obsolete and not got["HP:1"].obsolete


def test_obographs(spark, tmp_path):
    base = "http://purl.obolibrary.org/obo/"
    doc = {"graphs": [{"nodes": [{"id": base + "MONDO_1", "lbl": "a", "meta": {"synonyms": [{"pred": "x", "val": "s"}], "xrefs": [{"val": "OMIM:1"}]}}, {"id": base + "MONDO_2", "meta": {"deprecated": True}}, {"id": base + "HP_1"}], "edges": [{"sub": base + "MONDO_1", "pred": "is_a", "obj": base + "MONDO_3"}]}]}
    nodes, edges = readers.obographs(spark, put(tmp_path, "m.json", json.dumps(doc, indent=1)))
    assert [(r.id, r.synonyms, r.xrefs) for r in nodes.collect()] == [("MONDO:1", ["s"], ["OMIM:1"])] and [tuple(r) for r in edges.collect()] == [("MONDO:1", "MONDO:3")]


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">P1|x|y desc\nacd\nEFG\n>P2 z\n" + "A" * 100 + "\n")
    df = readers.fasta(spark, path)
    assert {(r.id, r.sequence) for r in df.collect()} == {("P1", "ACDEFG"), ("P2", "A" * 100)}
    writers.fasta(df, str(tmp_path / "out"))
    assert {(r.id, r.sequence) for r in readers.fasta(spark, str(tmp_path / "out")).collect()} == {("P1", "ACDEFG"), ("P2", "A" * 100)}


def atom(serial, name, alt, res, chain, num, x, b):
    return f"ATOM  {serial:5d}  {name:<3}{alt}{res:>3} {chain}{num:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:6.2f}"


def test_pdb(spark, tmp_path):
    lines = [atom(1, "N", " ", "GLY", "A", 1, 9, 50), atom(2, "CA", " ", "GLY", "A", 1, 1.5, 90.5), atom(3, "CA", "B", "ALA", "A", 2, 2, 80), atom(4, "CA", "A", "ALA", "A", 2, 3, 70), atom(5, "CA", " ", "SEC", "A", 3, 4, 60)]
    path = put(tmp_path, "a.pdb", "\n".join(lines) + "\n")
    assert [(r.i, r.residue, r.number, r.x, r.plddt) for r in readers.pdb_trace(spark, path, strict=False).orderBy("i").collect()] == [(0, "G", 1, 1.5, 90.0), (1, "A", 2, 2.0, 80.0), (2, "U", 3, 4.0, 60.0)]
    with pytest.raises(Exception, match="unknown residue"):
        readers.pdb_trace(spark, path).collect()
    short = put(tmp_path, "b.pdb", "\n".join(lines[:4]) + "\n")
    assert [(r.residue, r.x) for r in readers.pdb_trace(spark, short).orderBy("i").collect()] == [("G", 1.5), ("A", 3.0)]


def test_jsonl_markdown_and_scripts(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"category":"useful","target_id":"x"}\nnot json\n{"category":"useful"}\n')
    assert readers.jsonl(spark, path, "category string, target_id string", strict=False, required=["category", "target_id"]).count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, path, "category string, target_id string").collect()
    md = put(tmp_path, "doc.md", "# T\n\nfirst\n\n" + "x" * 30 + "\n\nlast\n\n| E-01 | a | [t](http://u) | c | d | e |\n| E-02 | short |\n")
    assert [(r.doc_id, r.text) for r in readers.markdown_chunks(spark, md, 20).orderBy("doc_id").collect()][:2] == [("MD:doc:1", "# T\n\nfirst"), ("MD:doc:2", "x" * 30)]
    assert [r.cells for r in readers.markdown_table(spark, md).collect()] == [["E-01", "a", "t", "c", "d", "e"]]
    assert spark.range(1).select(readers.script_json(F.lit('window.X = {"a": {"b": 1}};'))).first()[0] == '{"a": {"b": 1}}'
    assert readers.manifest(spark, str(tmp_path / "no.json")) == {}
    assert readers.newest_release(spark, str(tmp_path), ["x"]) is None


def test_mapping_and_sinks(spark, tmp_path):
    path = put(tmp_path, "m.tsv", "P1-2\tR1\tu\tname\tTAS\tHomo sapiens\nP2\tR1\tu\tname\tTAS\tMus musculus\n")
    df = readers.mapping_tsv(spark, path, "Homo sapiens")
    assert [(r.accession, r.pathway_id) for r in df.collect()] == [("P1", "R1")]
    writers.csv(df, str(tmp_path / "c"), ["pathway_id", "accession"])
    assert readers.csv(spark, str(tmp_path / "c")).columns == ["pathway_id", "accession"]
    writers.jsonl(df, str(tmp_path / "j"), "accession")
    writers.manifest(str(tmp_path / "man"), spark, b=1, a=2)
    assert readers.manifest(spark, str(tmp_path / "man")) == {"a": 2, "b": 1}
    assert writers.file_hashes(spark, path).first().sha256 is not None
    writers.merge_batches(df, lambda rows: None, 1)
