"""Region views: coverage, pileup and read segments of a bounded region."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators.dna import passing


def parse_region(text: str) -> tuple[str, int, int]:
    """chrom:start-end (1-based, commas allowed) or chrom:pos, which means 500 on either side. 0-based and half-open."""
    m = re.fullmatch(r"([^:]+):([\d,]+)(?:-([\d,]+))?", text.strip())
    if not m:
        raise ValueError(f"not a region: {text}")
    start = int(m[2].replace(",", ""))
    if m[3] is None:
        return m[1], max(0, start - 1 - 500), start + 500
    end = int(m[3].replace(",", ""))
    if start < 1 or end < start:
        raise ValueError(f"not a region: {text}")
    return m[1], start - 1, end


def pad_region(start: int, end: int, flank: int | None = None) -> tuple[int, int]:
    """By the flank, or an eighth of the span between 200 and 5,000."""
    pad = flank if flank is not None else min(max((end - start) // 8, 200), 5_000)
    return max(0, start - pad), end + pad


def in_region(records: DataFrame, chrom: str, start: int, end: int, mapq: int = 0) -> DataFrame:
    """Passing records whose reference span overlaps the region; chr is optional in names."""
    same = F.regexp_replace("contig", "^chr", "") == re.sub("^chr", "", chrom)
    return passing(records, mapq).filter(same & (F.col("pos0") < end) & (F.col("pos0") + G.reference_span("cigar") > start))


def sample_reads(records: DataFrame, n: int) -> DataFrame:
    """n reads by hash of name and place: the same ones each time."""
    return records.orderBy(F.md5(F.concat_ws(":", "qname", F.col("pos0").cast("string"))), "qname", "pos0", "flag").limit(n)


def steps(records: DataFrame) -> DataFrame:
    """The records with `steps`: array of (op, len, ref, query), where each operation begins (0-based)."""
    walked = F.aggregate(
        G.cigar_ops("cigar"),
        F.struct(F.col("pos0").cast("bigint").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<op:string,len:int,ref:bigint,query:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["r"] + F.when(x["op"].isin(*"MDN=X"), x["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(x["op"].isin(*"MIS=X"), x["len"]).otherwise(0)).alias("q"),
            F.concat(s["out"], F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), s["r"].alias("ref"), s["q"].alias("query")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return records.withColumn("steps", walked)


def coverage(records: DataFrame, start: int, end: int) -> DataFrame:
    """pos, depth of every position of the region, 0 included."""
    blocks = records.select(F.explode(G.aligned_blocks("cigar", "pos0")).alias("b")).select(F.greatest("b.start", F.lit(start)).alias("a"), F.least("b.end", F.lit(end)).alias("z")).filter("a < z")
    per = blocks.select(F.explode(F.sequence("a", F.col("z") - 1)).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("depth"))
    return records.sparkSession.range(start, end).withColumnRenamed("id", "pos").join(per, "pos", "left").na.fill(0, ["depth"])


def pileup(records: DataFrame, start: int, end: int) -> DataFrame:
    """Per position with evidence: n_a .. n_n, ins and ins_len (at the base before), del_starts, del_spanning."""
    s = steps(records).select("seq", F.explode("steps").alias("s")).select("seq", "s.*")
    bases = s.filter(F.col("op").isin(*"M=X") & (F.col("len") > 0)).select("seq", "query", "ref", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k")).select((F.col("ref") + F.col("k")).alias("pos"), G.base_class(F.substr("seq", F.col("query") + F.col("k") + 1, F.lit(1))).alias("base"))
    of_bases = bases.groupBy("pos").agg(*[F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in "ACGTN"])
    ins = s.filter("op = 'I'").groupBy((F.col("ref") - 1).alias("pos")).agg(F.count(F.lit(1)).alias("ins"), F.sum("len").alias("ins_len"))
    gone = s.filter("op = 'D' and len > 0")
    del_starts = gone.groupBy(F.col("ref").alias("pos")).agg(F.count(F.lit(1)).alias("del_starts"))
    spanning = gone.select(F.explode(F.sequence("ref", F.col("ref") + F.col("len") - 1)).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("del_spanning"))
    out = of_bases
    for other in (ins, del_starts, spanning):
        out = out.join(other, "pos", "full")
    return out.na.fill(0).filter((F.col("pos") >= start) & (F.col("pos") < end))


#: What is drawn for each operation. Fixed values.
KINDS = {"M": "match", "=": "match", "X": "mismatch", "I": "insertion", "D": "deletion", "N": "skip", "S": "soft_clip"}


def query_bases(records: DataFrame) -> DataFrame:
    """The records' columns but cigar, with op, ref and bases of each insertion and soft clip. Records: cigar, pos0, seq."""
    s = steps(records).select(*[c for c in records.columns if c not in ("cigar", "seq")], "seq", F.explode(F.filter("steps", lambda x: x["op"].isin("I", "S"))).alias("x"))
    return s.select(*[c for c in s.columns if c not in ("seq", "x")], F.col("x.op").alias("op"), F.col("x.ref").alias("ref"), F.substr("seq", F.col("x.query") + 1, F.col("x.len")).alias("bases"))


def mismatched(reference: str, start: int, end: int) -> Column:
    """Of rows with steps and seq: array of (kind, start, end), a segment for each base that differs from the region's reference."""
    ref = F.lit(reference.upper())

    def of(x: Column) -> Column:
        places = F.filter(F.sequence(F.greatest(x["ref"], F.lit(start)), F.least(x["ref"] + x["len"], F.lit(end)) - 1), lambda p: F.substr("seq", (x["query"] + p - x["ref"] + 1).cast("int"), F.lit(1)) != "")
        known = lambda p: F.substr(ref, (p - start + 1).cast("int"), F.lit(1))
        here = lambda p: F.upper(F.substr("seq", (x["query"] + p - x["ref"] + 1).cast("int"), F.lit(1)))
        return F.transform(F.filter(places, lambda p: known(p).isin(*"ACGT") & here(p).isin(*"ACGT") & (known(p) != here(p))), lambda p: F.struct(F.lit("mismatch").alias("kind"), p.alias("start"), (p + 1).alias("end")))

    over = F.filter("steps", lambda x: x["op"].isin(*"M=X") & (x["ref"] < end) & (x["ref"] + x["len"] > start))
    return F.flatten(F.transform(over, of))


def segments(records: DataFrame, start: int, end: int, reference: str | None = None) -> DataFrame:
    """qname, flag, hp, segments: array of (kind, start, end) clipped to the region; insertions and soft clips are points. With the region's reference, which needs seq, mismatches come after what they lie on."""
    kind = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])
    drawn = F.filter(F.transform("steps", lambda x: F.struct(kind[x["op"]].alias("kind"), F.greatest(x["ref"], F.lit(start)).alias("start"), F.least(F.when(x["op"].isin("I", "S"), x["ref"]).otherwise(x["ref"] + x["len"]), F.lit(end)).alias("end"))), lambda x: x["kind"].isNotNull() & (x["start"] <= x["end"]) & (x["end"] >= start) & (x["start"] <= end))
    own = records if "hp" in records.columns else records.withColumn("hp", F.lit(None).cast("int"))
    every = drawn if reference is None else F.concat(drawn, mismatched(reference, start, end))
    return steps(own).select("qname", "flag", "hp", "pos0", every.alias("segments"))


def snapshot(records: DataFrame, transcripts: DataFrame | None, markers: DataFrame | None, region: str, most_reads: int = 200) -> str:
    """A region as SVG. Regions are at most a megabase; reads beyond most_reads are sampled for display only."""
    from helixgrid.sinks.svg import region_plot
    from helixgrid.sources.annotation import genes_in_region

    chrom, start, end = parse_region(region)
    if end - start > 1_000_000:
        raise ValueError("a region is one megabase at most")
    own = in_region(records, chrom, start, end)
    depth = {r.pos: r.depth for r in coverage(own, start, end).toLocalIterator()}
    piled = [r.asDict() | {"depth": depth.get(r.pos, 0)} for r in pileup(own, start, end).toLocalIterator()]
    reads = [{"segments": [(s.kind, s.start, s.end) for s in r.segments]} for r in segments(sample_reads(own, most_reads), start, end).orderBy("pos0", "qname").collect()]
    genes = [] if transcripts is None else [{"name": r.gene_name or r.gene_id, "strand": r.strand, "exons": [(e.start, e.end) for e in r.exons]} for r in genes_in_region(transcripts, chrom, start, end).collect()]
    marks = [] if markers is None else [{"pos": r.pos - 1, "label": r.label or "", "end_pos": r.end_pos} for r in markers.filter((F.regexp_replace("chrom", "^chr", "") == re.sub("^chr", "", chrom)) & F.col("pos").between(start + 1, end)).collect()]
    return region_plot(f"{chrom}:{start + 1:,}-{end:,}", start, end, genes, piled, reads, marks)
