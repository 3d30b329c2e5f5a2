import gzip
import json
import os
import struct
import threading
import zlib
from functools import partial
from http.server import HTTPServer, SimpleHTTPRequestHandler

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowlens import api
from rowlens.errors import DiffError
from rowlens.functions import where
from rowlens.plans.options import Options
from rowlens.plans.schema import columns_of
from rowlens.sources import avro, lake
from rowlens.sources.dataset import open_dataset


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    (gzip.open if path.endswith(".gz") else open)(path, "wt", encoding="utf-8", newline="").write(text)
    return str(path)


def kinds(data):
    return {c.name: (c.kind.value, c.nullable) for c in columns_of(data.df.schema)[0]}


def test_csv_inference(spark, tmp_path):
    p = put(f"{tmp_path}/a.csv", "b,i,f,d,t,s,e,m\ntrue,1,1.5,2024-02-29,2024-01-01T00:00:00Z,x,,1\nFALSE,-2,1e3,2024-01-01,2024-01-01 10:00:00.1234567+02:00,,,\n")
    d = open_dataset(spark, p)
    assert {k: v[0] for k, v in kinds(d).items()} == {"b": "bool", "i": "int64", "f": "float64", "d": "date", "t": "timestamp", "s": "string", "e": "string", "m": "int64"}
    assert kinds(d)["m"][1] and not kinds(d)["i"][1]
    rows = d.df.selectExpr("s", "e", "m", "unix_micros(t) t").collect()
    assert [(r.s, r.e, r.m) for r in rows] == [("x", "", 1), ("", "", None)] and rows[1].t == 1704096000123456


@pytest.mark.parametrize("text, kind", [("1.5f", "string"), (" 5", "string"), ("1e400", "string"), ("-inf", "float64"), ("NaN", "float64"), ("-nan", "string"), ("0x1p3", "float64"), ("2023-02-30", "string"), ("99999999999999999999", "float64"), ("True", "bool"), ("tRue", "string")])
def test_inference_guards(spark, tmp_path, text, kind):
    assert kinds(open_dataset(spark, put(f"{tmp_path}/a.csv", f"id,v\n1,{text}\n")))["v"][0] == kind


def test_csv_quotes_lines_and_bom(spark, tmp_path):
    p = put(f"{tmp_path}/a.csv", '﻿id,s\r\n1,"a, ""b""\nc"\r\n2,ü\r\n')
    assert [(r.id, r.s) for r in open_dataset(spark, p).df.collect()] == [(1, 'a, "b"\nc'), (2, "ü")]


@pytest.mark.parametrize("name, text", [("e.csv", ""), ("r.csv", "a,b\n1,2\n1,2,3\n"), ("d.csv", "a,a\n1,2\n"), ("e.ndjson", ""), ("b.ndjson", '{"a":1}\n{"a":\n'), ("f.parquet", "PAR1nonsense"), ("x.xls", "1"), ("n.ndjson", '{"a":{"b":1}}\n')])
def test_broken_inputs_end_in_an_error(spark, tmp_path, name, text):
    from rowlens.__main__ import main

    good = put(f"{tmp_path}/good.csv", "a,b\n1,2\n")
    assert main([put(f"{tmp_path}/{name}", text), good, "--key", "a"]) == 2


def test_retype_after_the_sample(spark, tmp_path):
    a = put(f"{tmp_path}/a.csv", "id,v\n" + "".join(f"{i},{i}\n" for i in range(30)) + "30,oops\n")
    b = put(f"{tmp_path}/b.csv", "id,v\n" + "".join(f"{i},{i}\n" for i in range(30)) + "30,31\n")
    r = api.diff(spark, a, b, Options(key=["id"], infer_rows=5))
    assert r.changed == 1 and any("read as text" in n for n in r.notes)


def test_formats_agree(spark, tmp_path):
    rows = [{"id": i, "f": i / 4, "s": f"v{i}", "d": "2024-01-%02d" % (i % 28 + 1), "n": None if i % 7 == 3 else i} for i in range(60)]
    text = "id,f,s,d,n\n" + "".join(f"{r['id']},{r['f']},{r['s']},{r['d']},{'' if r['n'] is None else r['n']}\n" for r in rows)
    paths = [put(f"{tmp_path}/a.csv", text), put(f"{tmp_path}/a.csv.gz", text), put(f"{tmp_path}/a.tsv", text.replace(",", "\t")), put(f"{tmp_path}/a.ndjson", "".join(json.dumps(r) + "\n" for r in rows))]
    import zstandard

    with open(f"{tmp_path}/a.csv.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(text.encode()))
    t = pa.Table.from_pylist(rows)
    pq.write_table(t.set_column(3, "d", t["d"].cast(pa.date32())), f"{tmp_path}/a.parquet")
    paths += [f"{tmp_path}/a.csv.zst", f"{tmp_path}/a.parquet"]
    for p in paths[1:]:
        r = api.diff(spark, paths[0], p, Options(key=["id"]))
        assert r.rows_same and r.unchanged == 60 and not [c for c in r.schema.type_changes], p


def test_packed_csv_folder_is_one_scan(spark, tmp_path):
    for i in range(3):
        put(f"{tmp_path}/d/part-{i}.csv.gz", "id,t,s\n" + "".join(f"{j},2024-01-01T00:00:0{j}.000Z,x{j}\n" for j in range(3 * i, 3 * i + 3)))
    put(f"{tmp_path}/d/part-4.csv.gz", "id,t,s\n")
    put(f"{tmp_path}/d/other.csv.gz", "id,n\n9,1.5\n")
    d = open_dataset(spark, f"{tmp_path}/d")
    assert len(d.raw) == 2 and not d.contradictions()
    want = [(i, 1704067200000000 + 1000000 * i, f"x{i}", None) for i in range(9)] + [(9, None, None, 1.5)]
    assert sorted(map(tuple, d.df.selectExpr("id", "unix_micros(t)", "s", "n").collect())) == want
    put(f"{tmp_path}/e/a.csv.gz", "id,t\n")
    e = open_dataset(spark, f"{tmp_path}/e")
    assert e.df.columns == ["id", "t"] and not e.df.count()


@pytest.mark.parametrize("text", ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00.5", "2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00+0200", "2024-01-01T00:00:00.1234567-02:30", "2024-13-01T00:00:00Z", "2024-01-01T00:00Z"])
def test_timestamps_of_all_forms(spark, text):
    from datetime import datetime, timezone

    from rowlens.sources.formats import value_as

    if "T00:00Z" in text or "-13-" in text:
        want = None
    else:
        t = datetime.fromisoformat(text)
        t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        want = round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 10**6)
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(value_as(df.c, "timestamp").alias("t")).selectExpr("unix_micros(t)").first()[0] == want


def test_ndjson_folders_with_files_without_records(spark, tmp_path):
    from rowlens.sources.formats import json_groups

    put(f"{tmp_path}/d/part-0.ndjson", "")
    put(f"{tmp_path}/d/part-1 %41.ndjson", '{"id":1,"v":2}\n')
    put(f"{tmp_path}/d/part-2.ndjson", ' \n{"id":2,"v":2.5}\n')
    files = [put(f"{tmp_path}/d/part-3.ndjson", '{"id":3,"v":1,"s":"x"}\n'), put(f"{tmp_path}/d/part-4.ndjson", '{"id":4,"v":null,"s":"y"}\n{"id":5,"v":7,"s":"z"}\n')]
    d = open_dataset(spark, f"{tmp_path}/d")
    assert sorted(map(tuple, d.df.select("id", "v", "s").collect())) == [(1, 2.0, None), (2, 2.5, None), (3, 1.0, "x"), (4, None, "y"), (5, 7.0, "z")]
    assert not d.contradictions()
    ((some, of, _),) = json_groups(spark, files, 1000)
    assert some == files and of == {"id": ("long", False), "v": ("long", True), "s": ("string", False)}
    put(f"{tmp_path}/e/part-0.ndjson", "")
    with pytest.raises(DiffError, match="no records"):
        open_dataset(spark, f"{tmp_path}/e")


def test_ndjson_kinds(spark, tmp_path):
    p = put(f"{tmp_path}/a.ndjson", '{"i":1,"f":1.5,"b":true,"t":"2024-01-01T00:00:00Z","m":1,"o":{"x":1},"s":"a"}\n{"i":2,"f":3,"b":null,"t":"2024-01-01T00:00:00Z","m":"x","i":3}\n')
    d = open_dataset(spark, p)
    assert {k: v[0] for k, v in kinds(d).items()} == {"b": "bool", "f": "float64", "i": "int64", "m": "string", "s": "string", "t": "timestamp"}
    assert [r.i for r in d.df.collect()] == [1, 3] and any("'o'" in w for w in d.warnings)


def test_hive_directory_union_and_pruning(spark, tmp_path):
    for region, text in (("eu", "id,v\n1,1\n"), ("us", "id,v\n2,2.5\n"), ("a%20p", "id,w\n3,x\n")):
        put(f"{tmp_path}/t/region={region}/p.csv", text)
    put(f"{tmp_path}/t/_skip/p.csv", "q\n1\n")
    d = open_dataset(spark, f"{tmp_path}/t")
    assert kinds(d)["v"][0] == "float64" and kinds(d)["region"][0] == "string"
    assert sorted((r.id, r.v, r.w, r.region) for r in d.df.collect())[0] == (1, 1.0, None, "eu")
    r = api.diff(spark, f"{tmp_path}/t", f"{tmp_path}/t", Options(key=["id"], where=["region = eu"]))
    assert r.files_pruned == 4 and r.unchanged == 1
    put(f"{tmp_path}/t/region=eu/q.csv", "id,v\n9,text\n")
    with pytest.raises(DiffError, match="'v'"):
        open_dataset(spark, f"{tmp_path}/t")


def test_partition_collision_and_missing_paths(spark, tmp_path):
    put(f"{tmp_path}/t/id=1/p.csv", "id,v\n1,1\n")
    for p in (f"{tmp_path}/t", f"{tmp_path}/none", f"{tmp_path}/none/*.csv", f"{tmp_path}#3"):
        with pytest.raises(DiffError):
            open_dataset(spark, p)


def test_parquet_footer(spark, tmp_path):
    schema = pa.schema([pa.field("id", pa.int64(), nullable=False), ("t", pa.timestamp("ns")), ("small", pa.decimal128(9, 2)), ("wide", pa.decimal128(30, 2)), ("l", pa.list_(pa.int32()))])
    pq.write_table(pa.table({"id": [1], "t": [1_500], "small": [None], "wide": [None], "l": [[1]]}, schema=schema), f"{tmp_path}/a.parquet", store_decimal_as_integer=True, version="2.6")
    d = open_dataset(spark, f"{tmp_path}/a.parquet")
    cols, warnings = columns_of(d.df.schema)
    assert {c.name: (c.kind.value, c.nullable) for c in cols} == {"id": ("int64", False), "t": ("timestamp", True), "small": ("float64", True)} and len(warnings) == 2
    assert d.df.selectExpr("unix_micros(cast(t as timestamp)) t").first().t == 1


def test_http(spark, tmp_path):
    put(f"{tmp_path}/a.csv", "id,v\n1,1\n")

    class Quiet(SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert api.diff(spark, f"{base}/a.csv", f"{tmp_path}/a.csv", Options(key=["id"])).same
    for bad in ("/none.csv", "/"):
        with pytest.raises(DiffError):
            open_dataset(spark, base + bad)
    server.shutdown()


# ---- lake tables


def array_bitmap(values):
    by = {}
    for v in values:
        by.setdefault(v >> 16, []).append(v & 0xFFFF)
    out = struct.pack("<II", 12346, len(by)) + b"".join(struct.pack("<HH", k, len(v) - 1) for k, v in sorted(by.items()))
    at = len(out) + 4 * len(by)
    for v in (by[k] for k in sorted(by)):
        out += struct.pack("<I", at)
        at += 2 * len(v) if len(v) <= 4096 else 8192
    for v in (by[k] for k in sorted(by)):
        out += np.array(sorted(v), "<u2").tobytes() if len(v) <= 4096 else np.packbits(np.isin(np.arange(65536), v), bitorder="little").tobytes()
    return struct.pack("<iq", 1681511377, 1) + struct.pack("<I", 0) + out


def test_roaring():
    for values in ([], [0], [5, 17, 42], list(range(0, 200000, 3)), list(range(70000))):
        assert lake.positions(array_bitmap(values), len(values)).tolist() == values
    runs = struct.pack("<iq", 1681511377, 1) + struct.pack("<I", 1) + struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 0, 4) + struct.pack("<HHHHH", 2, 3, 1, 10, 2)
    assert lake.positions(runs).tolist() == [(1 << 32) + x for x in (3, 4, 10, 11, 12)]
    for bad in (b"", b"\0" * 20, array_bitmap([1])[:-1]):
        with pytest.raises(DiffError):
            lake.positions(bad)
    with pytest.raises(DiffError, match="cardinality"):
        lake.positions(array_bitmap([1]), 2)


def encode85(data):
    alphabet, out = lake._Z85, ""
    for i in range(0, len(data), 4):
        n, part = struct.unpack(">I", data[i : i + 4])[0], ""
        for _ in range(5):
            n, part = n // 85, alphabet[n % 85] + part
        out += part
    return out


def delta(root):
    os.makedirs(f"{root}/_delta_log")
    def data(name, ids, region):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        pq.write_table(pa.table({"id": ids, "amount": [float(i) for i in ids]}), f"{root}/{name}")
        return {"add": {"path": name, "partitionValues": {"region": region}, "size": 1, "modificationTime": 0, "dataChange": True, "stats": json.dumps({"numRecords": len(ids)})}}
    def commit(v, *actions):
        with open(f"{root}/_delta_log/{v:020}.json", "w") as f:
            f.writelines(json.dumps(a) + "\n" for a in actions)
    eu, us = data("region=eu/a.parquet", list(range(100)), "eu"), data("region=us/b%20c.parquet".replace("%20", " "), list(range(100, 150)), "us")
    us["add"]["path"] = "region=us/b%20c.parquet"
    commit(0, {"protocol": {"minReaderVersion": 1}}, eu, us)
    more = data("region=ap/c.parquet", list(range(200, 210)), "ap")
    commit(1, more)
    raw = array_bitmap([5, 17, 42])
    bits = raw + b"\0" * (-len(raw) % 4)
    gone = {"add": eu["add"] | {"deletionVector": {"storageType": "i", "pathOrInlineDv": encode85(bits), "sizeInBytes": len(raw), "cardinality": 3}}}
    commit(2, gone)
    os.makedirs(f"{root}/ab")
    uuid = bytes(range(16))
    h = uuid.hex()
    with open(f"{root}/ab/deletion_vector_{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}.bin", "wb") as f:
        f.write(b"\x01" + struct.pack(">i", len(raw)) + raw + struct.pack(">I", zlib.crc32(raw)))
    filed = {"add": eu["add"] | {"deletionVector": {"storageType": "u", "pathOrInlineDv": "ab" + encode85(uuid), "offset": 1, "sizeInBytes": len(raw), "cardinality": 3}}}
    commit(3, {"remove": {"path": "region=us/b%20c.parquet"}}, filed)
    return root


def test_delta(spark, tmp_path):
    root = delta(f"{tmp_path}/t")
    count = lambda v: open_dataset(spark, f"{root}#{v}").df.count()
    assert [count(v) for v in range(4)] == [150, 160, 157, 107]
    assert {r.region for r in open_dataset(spark, f"{root}#1").df.select("region").distinct().collect()} == {"eu", "us", "ap"}
    r = api.diff(spark, f"{root}#0", f"{root}#1", Options(key=["id"]))
    assert (r.added, r.removed, r.changed, r.unchanged, r.left_rows) == (10, 0, 0, 150, 150) and any("not read" in n for n in r.notes)
    r = api.diff(spark, f"{root}#1", f"{root}#2", Options(key=["id"]))
    assert (r.added, r.removed, r.unchanged) == (0, 3, 157) and r.removed_examples == ["17", "42", "5"]
    r = api.diff(spark, f"{root}#2", f"{root}#3", Options(key=["id"]))
    assert (r.added, r.removed, r.unchanged) == (0, 50, 107)
    for bad in ("9", "x"):
        with pytest.raises(DiffError):
            open_dataset(spark, f"{root}#{bad}")
    os.remove(f"{root}/_delta_log/{1:020}.json")
    with pytest.raises(DiffError, match="missing"):
        open_dataset(spark, f"{root}#2")
    with open(f"{root}/_delta_log/{1:020}.checkpoint.parquet", "wb") as f:
        paths = [("region=eu/a.parquet", "eu", 100), ("region=us/b%20c.parquet", "us", 50), ("region=ap/c.parquet", "ap", 10)]
        pq.write_table(pa.Table.from_pylist([{"add": {"path": p, "partitionValues": [("region", r)], "stats": json.dumps({"numRecords": n})}} for p, r, n in paths], schema=pa.schema([("add", pa.struct([("path", pa.string()), ("partitionValues", pa.map_(pa.string(), pa.string())), ("stats", pa.string())]))])), f)
    assert [count(v) for v in (1, 2, 3)] == [160, 157, 107]


def avro_file(path, schema, rows):
    def long(n):
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def enc(t, v):
        if isinstance(t, list):
            i = next(i for i, x in enumerate(t) if (x == "null") == (v is None))
            return long(i) + enc(t[i], v)
        if isinstance(t, dict) and t["type"] == "record":
            return b"".join(enc(f["type"], v.get(f["name"])) for f in t["fields"])
        if isinstance(t, dict) and t["type"] == "array":
            return (long(len(v)) + b"".join(enc(t["items"], x) for x in v) if v else b"") + long(0)
        return {"null": lambda: b"", "int": lambda: long(v), "long": lambda: long(v), "string": lambda: long(len(v.encode())) + v.encode()}[t]()

    blob = lambda b: long(len(b)) + b
    body = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = body.compress(b"".join(enc(schema, r) for r in rows)) + body.flush()
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"deflate"}
    with open(path, "wb") as f:
        f.write(b"Obj\x01" + long(len(meta)) + b"".join(blob(k.encode()) + blob(v) for k, v in meta.items()) + long(0) + b"m" * 16 + long(len(rows)) + blob(packed) + b"m" * 16)


FILE = {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "partition", "type": {"type": "record", "name": "r102", "fields": [{"name": "region", "type": ["null", "string"]}]}}, {"name": "record_count", "type": "long"}, {"name": "equality_ids", "type": ["null", {"type": "array", "items": "int"}]}]}
ENTRY = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": FILE}]}
LIST = {"type": "record", "name": "list", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}]}


def test_iceberg(spark, tmp_path):
    root, was = f"{tmp_path}/t", "s3://bucket/elsewhere/t"
    os.makedirs(f"{root}/metadata"), os.makedirs(f"{root}/data")
    def data(name, **cols):
        pq.write_table(pa.table(cols), f"{root}/data/{name}")
    data("a.parquet", id=list(range(1000)), amount=[float(i) for i in range(1000)])
    data("pos.parquet", file_path=[f"{was}/data/a.parquet"] * 3, pos=[3, 500, 999])
    data("eq.parquet", id=[10, 20])
    data("b.parquet", id=[10, 2000], amount=[-1.0, 1.0])
    one = lambda content, name, n, seq=None, ids=None, status=1: {"status": status, "sequence_number": seq, "data_file": {"content": content, "file_path": f"{was}/data/{name}", "file_format": "PARQUET", "partition": {"region": None}, "record_count": n, "equality_ids": ids}}
    manifests = {"m1": (1, [one(0, "a.parquet", 1000)]), "m2": (2, [one(1, "pos.parquet", 3)]), "m3": (3, [one(2, "eq.parquet", 2, ids=[1]), one(0, "gone.parquet", 1, status=2)]), "m4": (3, [one(0, "b.parquet", 2)])}
    for name, (_, rows) in manifests.items():
        avro_file(f"{root}/metadata/{name}.avro", ENTRY, rows)
    snapshots = []
    for sid, names in ((11, ["m1"]), (12, ["m1", "m2"]), (13, ["m1", "m2", "m3", "m4"])):
        avro_file(f"{root}/metadata/snap-{sid}.avro", LIST, [{"manifest_path": f"{was}/metadata/{n}.avro", "sequence_number": manifests[n][0]} for n in names])
        snapshots.append({"snapshot-id": sid, "manifest-list": f"{was}/metadata/snap-{sid}.avro"})
    with open(f"{root}/metadata/v3.metadata.json", "w") as f:
        json.dump({"location": was, "current-snapshot-id": 13, "snapshots": snapshots, "schemas": [{"fields": [{"id": 1, "name": "id"}, {"id": 2, "name": "amount"}]}]}, f)
    r = api.diff(spark, f"{root}#11", f"{root}#12", Options(key=["id"]))
    assert (r.added, r.removed, r.changed, r.unchanged) == (0, 3, 0, 997)
    r = api.diff(spark, f"{root}#12", f"{root}#13", Options(key=["id"]))
    assert (r.added, r.removed, r.changed, r.unchanged) == (1, 1, 1, 995)
    assert open_dataset(spark, root).df.count() == 997
    with pytest.raises(DiffError, match="11, 12, 13"):
        open_dataset(spark, f"{root}#99")
    with pytest.raises(DiffError):
        list(avro.records(b"nope"))


# ---- baselines, exports, command line


def avro_table(root, location, entries, spark, deletes=()):
    """An Iceberg table of Parquet files that exist below root; entries and deletes: (recorded path, rows)."""
    status = {"type": "record", "name": "r", "fields": [{"name": "status", "type": "int"}, {"name": "sequence_number", "type": "long"}, {"name": "data_file", "type": {"type": "record", "name": "d", "fields": [
        {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}]}}]}
    listed = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}]}
    rows = [{"status": 1, "sequence_number": 1, "data_file": {"content": 0, "file_path": f"{location}/{p}", "file_format": "PARQUET", "record_count": n}} for p, n in entries]
    rows += [{"status": 1, "sequence_number": 2, "data_file": {"content": 1, "file_path": f"{location}/{p}", "file_format": "PARQUET", "record_count": n}} for p, n in deletes]
    os.makedirs(f"{root}/metadata", exist_ok=True)
    avro_file(f"{root}/metadata/m.avro", status, rows)
    avro_file(f"{root}/metadata/l.avro", listed, [{"manifest_path": f"{location}/metadata/m.avro", "sequence_number": 2}])
    meta = {"location": location, "current-snapshot-id": 1, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "id"}]}], "snapshots": [{"snapshot-id": 1, "manifest-list": f"{location}/metadata/l.avro"}]}
    put(f"{root}/metadata/v1.metadata.json", json.dumps(meta))


@pytest.fixture(scope="module")
def mounted(spark, tmp_path_factory):
    """A folder, and the same under an address that only Hadoop's file systems can open."""
    root = tmp_path_factory.mktemp("mounted")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./x", f"file://{root}")
    return str(root), "viewfs://t/x"


def test_position_deletes_by_whole_path(spark, mounted):
    for name, location in (("one", "s3://bucket/warehouse/one"), ("two", "hdfs://h:8020/w/two")):
        root = f"{mounted[0]}/{name}"
        for part, first in (("p=a", 0), ("p=b", 10)):
            os.makedirs(f"{root}/data/{part}")
            pq.write_table(pa.table({"id": list(range(first, first + 5))}), f"{root}/data/{part}/part-0.parquet")
        pq.write_table(pa.table({"file_path": [f"{location}/data/p=a/part-0.parquet"] * 2, "pos": pa.array([1, 2], pa.int64())}), f"{root}/data/deletes.parquet")
        avro_table(root, location, [("data/p=a/part-0.parquet", 5), ("data/p=b/part-0.parquet", 5)], spark, [("data/deletes.parquet", 2)])
        for path in (root, f"{mounted[1]}/{name}", f"{root}#1", f"{mounted[1]}/{name}#1"):
            assert sorted(r.id for r in open_dataset(spark, path).df.collect()) == [0, 3, 4, 10, 11, 12, 13, 14], path


def test_addresses_of_other_file_systems(spark, mounted):
    root, address = mounted
    delta(f"{root}/delta")
    for version in ("", "#0", "#1"):
        here, there = (open_dataset(spark, f"{x}/delta{version}") for x in mounted)
        assert sorted(map(tuple, here.df.collect()), key=str) == sorted(map(tuple, there.df.collect()), key=str)
    for i, region in enumerate(("north", "south")):
        os.makedirs(f"{root}/hive/region={region}")
        pq.write_table(pa.table({"id": [2 * i, 2 * i + 1]}), f"{root}/hive/region={region}/x.parquet")
        put(f"{root}/text/f{i}.csv", f"id,v\n{i},1\n{i + 10},2\n")
    put(f"{root}/lines.ndjson", '{"id": 1}\n{"id": 2}\n')
    assert sorted(map(tuple, open_dataset(spark, f"{address}/hive").df.collect())) == [(0, "north"), (1, "north"), (2, "south"), (3, "south")]
    assert kinds(open_dataset(spark, f"{address}/text")) == kinds(open_dataset(spark, f"{root}/text")) and open_dataset(spark, f"{address}/text/*.csv").df.count() == 4
    assert open_dataset(spark, f"{address}/lines.ndjson").df.count() == 2
    assert api.diff(spark, f"{root}/hive", f"{address}/hive", Options(key=["id"])).same
    for bad in (f"{address}/none", f"{address}/none/*.csv", "nosuch://t/x.parquet"):
        with pytest.raises(DiffError):
            open_dataset(spark, bad)


def test_lake_files_are_pruned_before_the_scan(spark, tmp_path):
    for r in "abcd":
        os.makedirs(f"{tmp_path}/t/region={r}")
        pq.write_table(pa.table({"id": [ord(r)]}), f"{tmp_path}/t/region={r}/x.parquet")
    add = lambda r: json.dumps({"add": {"path": f"region={r}/x.parquet", "partitionValues": {"region": r}, "size": 1, "modificationTime": 0, "dataChange": True}})
    put(f"{tmp_path}/t/_delta_log/{0:020}.json", "\n".join(map(add, "abcd")))
    for spec, want in (("region = a", "a"), ("region > b", "cd"), ("region = z", "")):
        data, gone = open_dataset(spark, f"{tmp_path}/t").pruned(where.parse([spec]))
        scanned = {x.rsplit("region=", 1)[1][0] for x in data.df.inputFiles()}
        assert gone == 4 - len(want) and (scanned == set(want) or not want)
        r = api.diff(spark, f"{tmp_path}/t", f"{tmp_path}/t", Options(key=["id"], where=[spec]))
        assert r.same and r.left_rows == len(want) and r.files_pruned == 2 * gone


def test_csv_without_quotes_is_split(spark, tmp_path):
    lines = "".join(f"{i},some text {i}\n" for i in range(40_000))
    put(f"{tmp_path}/plain.csv", "id,v\n" + lines)
    put(f"{tmp_path}/quoted.csv", "id,v\n" + lines + '40000,"two\nlines"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        plain, whole = (open_dataset(spark, f"{tmp_path}/{n}.csv").df for n in ("plain", "quoted"))
        assert plain.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
        assert (plain.count(), whole.count()) == (40_000, 40_001) and whole.where("v = 'two\nlines'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_directories_sample_each_file(spark, tmp_path):
    put(f"{tmp_path}/d/a.csv", "id,v\n" + "".join(f"{i},{i}\n" for i in range(50)) + "x,1\n")
    put(f"{tmp_path}/d/b.csv", "id,v\n1,2.5\n")
    data = open_dataset(spark, f"{tmp_path}/d", infer_rows=20)
    assert dict(data.df.dtypes) == {"id": "bigint", "v": "double"} and data.contradictions() == {"id"}
    assert sorted(r.id for r in data.retyped({"id"}).df.collect())[-1] == "x"
    with pytest.raises(DiffError):  # with all rows sampled, the files' kinds are at odds
        open_dataset(spark, f"{tmp_path}/d", infer_rows=-1)


def test_nested_values_after_the_sample_are_refused(spark, tmp_path):
    p = put(f"{tmp_path}/a.ndjson", '{"id": 1, "s": "{x"}\n{"id": 2, "s": "[1]"}\n{"id": 3, "s": {"n": 1}}\n')
    df = open_dataset(spark, p, infer_rows=2).df
    assert [r.s for r in df.where("id < 3").orderBy("id").collect()] == ["{x", "[1]"]
    with pytest.raises(Exception, match="nested value"):
        df.collect()


def test_queries_that_sql_cannot_say(spark):
    import xxhash

    from rowlens import queries

    def shown(x):
        return None if x is None else "xxh:" + xxhash.xxh64_hexdigest(f"{x:.6f}".rstrip("0").rstrip(".").encode(), 0)[:8]

    masked = {r.o_orderkey: r for r in queries.queries()["diff_mask"](spark, "/root/testdata/sf0.001").collect()}
    plain = {r.o_orderkey: r for r in queries.queries()["diff_rows"](spark, "/root/testdata/sf0.001").collect()}
    assert masked.keys() == plain.keys() and len(plain) > 20
    for k, r in plain.items():
        assert (masked[k].o_totalprice__left, masked[k].o_totalprice__right) == (shown(r.o_totalprice__left), shown(r.o_totalprice__right))


def test_progress(spark, capsys):
    from rowlens.output.progress import Progress

    told = []
    with Progress(spark, lambda *x: told.append(x), every=0.01):
        spark.range(4_000_000, numPartitions=40).selectExpr("max(sha2(string(id), 256))").collect()
    assert told and all(a <= b for a, b in told)


def test_baseline(spark, tmp_path):
    left = spark.createDataFrame([(i, i % 5, f"s{i}") for i in range(50)], "id long, v long, s string")
    right = left.where("id <> 7").selectExpr("id", "case when id = 9 then 99 else v end v", "s").union(spark.createDataFrame([(100, 1, "x")], "id long, v long, s string"))
    path = f"{tmp_path}/base"
    assert api.create_baseline(spark, left, path, Options(ignore_case=True))["rows"] == 50
    r = api.diff_baseline(spark, path, right)
    assert (r.added, r.removed, r.changed, r.unchanged) == (1, 1, 1, 48) and r.added_examples == ["100"] and r.changed_examples[0]["key"] == "9" and "case" in r.comparison
    for o in (Options(tolerance="1"), Options(where=["v = 1"]), Options(float_precision=3), Options(on_dup="match"), Options(ignore_columns=["v"])):
        with pytest.raises(DiffError):
            api.diff_baseline(spark, path, right, o)
    with pytest.raises(DiffError, match="repeat"):
        api.diff_baseline(spark, path, right.union(right))
    with pytest.raises(DiffError, match="repeat"):
        api.create_baseline(spark, left.union(left), f"{tmp_path}/b2", Options(key=["id"]))
    with pytest.raises(DiffError, match="not a baseline"):
        api.diff_baseline(spark, f"{tmp_path}/none", right)


def test_command_line(spark, tmp_path, capsys):
    from rowlens.__main__ import main, run

    a = put(f"{tmp_path}/a.csv", "id,v,s\n1,1.5,x\n2,2.5,y\n3,3.5,z\n")
    b = put(f"{tmp_path}/b.csv", "id,v,s\n1,1.5,x\n2,2.75,y\n4,4.5,w\n")
    out, html, md = f"{tmp_path}/d.csv", f"{tmp_path}/r.html", f"{tmp_path}/r.md"
    assert main([a, b, "--format", "json", "--output", out, "--report", html, "--report", md]) == 1
    got = json.loads(capsys.readouterr().out)
    assert (got["added"], got["removed"], got["changed"], got["equal"]) == (1, 1, 1, False) and got["column_stats"]["v"]["max_abs_diff"] == 0.25
    assert sorted(open(out).read().splitlines()) == sorted(["id,diff_status,v__left,v__right,s__left,s__right", "2,changed,2.5,2.75,y,y", "3,removed,3.5,,z,", "4,added,,4.5,,w"])
    assert "<script>" in open(html).read() and "| Added | 1 |" in open(md).read()
    assert main([a, b, "--output", f"{tmp_path}/d.parquet"]) == 1 and pq.read_table(f"{tmp_path}/d.parquet").num_rows == 3
    assert main([a, b, "--max-diff", "3"]) == 0 and main([a, a]) == 0 and main(["schema", a, b]) == 0 and main(["--version"]) == 0
    assert main([a, b, "--format", "markdown", "--summary"]) == 1
    base = f"{tmp_path}/base"
    assert main(["snapshot", a, "--output", base, "--key", "id"]) == 0 and main([b, "--against", base]) == 1 and main([a, "--against", base]) == 0
    for bad in ([a], [a, b, "--nope"], [a, b, "--on-dup", "x"], [a, b, "--key", "q"], ["snapshot", a], [a, b, "--rename", "x"], [a, f"{tmp_path}/none.csv"]):
        assert main(bad) == 2
    assert "error:" in capsys.readouterr().err
    with pytest.raises(DiffError):
        run(["snapshot", a, b, "--output", base])
