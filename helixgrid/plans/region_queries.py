"""Queries over regions, fragments, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators import annotation as N
from helixgrid.operators import rna as R
from helixgrid.operators import snapshot as S
from helixgrid.plans import fixtures as X
from helixgrid.plans.alignment_queries import KEY, KEYS, MD, PRIMARY, alnc
from helixgrid.plans.fixtures import load, sql
from helixgrid.plans.registry import register
from helixgrid.plans.rna_queries import ENDS, ORD, PAIR, T, transcripts

REGION, START, END = "chr5", 1_000, 1_300
IN = f"SELECT * FROM m WHERE contig = '{REGION}' AND {PRIMARY}"
AT = f"SELECT CAST(p AS BIGINT) AS pos FROM range({START}, {END}) q(p)"
#: Blocks of the region's reads, by arithmetic.
BL = """SELECT pos0 AS s, pos0 + mlen AS z FROM i WHERE l_linenumber % 4 IN (0, 1) UNION ALL SELECT pos0, pos0 + 10 FROM i WHERE l_linenumber % 4 IN (2, 3) UNION ALL SELECT pos0 + 110, pos0 + 100 + mlen FROM i WHERE l_linenumber % 4 = 2
 UNION ALL SELECT pos0 + 10, pos0 + 15 FROM i WHERE l_linenumber % 4 = 3 UNION ALL SELECT pos0 + 18, pos0 + 3 + mlen FROM i WHERE l_linenumber % 4 = 3"""


def _records(s, d):
    return S.in_region(load(s, d, MD), REGION, START, END)


@register("a37_region_coverage", sql("SELECT pos, count(s) AS depth FROM at LEFT JOIN bl ON s <= pos AND pos < z GROUP BY pos".replace("FROM at", "FROM place"), m=MD, i=IN, place=AT, bl=BL))
def a37(s, d):
    return S.coverage(_records(s, d), START, END)


@register("a37_pileup", sql(f"""SELECT pos, CAST(coalesce(c, 0) AS BIGINT) AS n_c, CAST(coalesce(ins, 0) AS BIGINT) AS ins, CAST(2 * coalesce(ins, 0) AS BIGINT) AS ins_len, CAST(coalesce(ds, 0) AS BIGINT) AS del_starts, CAST(coalesce(dp, 0) AS BIGINT) AS del_spanning FROM place
 LEFT JOIN (SELECT pos AS p1, count(*) AS c FROM place JOIN bl ON s <= pos AND pos < z GROUP BY pos) ON p1 = pos
 LEFT JOIN (SELECT pos0 + 9 AS p2, count(*) AS ins FROM i WHERE l_linenumber % 4 = 3 GROUP BY 1) ON p2 = pos
 LEFT JOIN (SELECT pos0 + 15 AS p3, count(*) AS ds FROM i WHERE l_linenumber % 4 = 3 GROUP BY 1) ON p3 = pos
 LEFT JOIN (SELECT pos AS p4, count(*) AS dp FROM place JOIN i ON l_linenumber % 4 = 3 AND pos0 + 15 <= pos AND pos < pos0 + 18 GROUP BY 1) ON p4 = pos
 WHERE c IS NOT NULL OR ins IS NOT NULL OR ds IS NOT NULL OR dp IS NOT NULL""", m=MD, i=IN, place=AT, bl=BL))
def a37b(s, d):
    return S.pileup(_records(s, d), START, END).select("pos", "n_c", "ins", "ins_len", "del_starts", "del_spanning")


SPAN = "mlen + CASE l_linenumber % 4 WHEN 2 THEN 100 WHEN 3 THEN 3 ELSE 0 END"


@register("w8_display_sample", sql(f"SELECT {KEYS} FROM i WHERE pos0 < {END} AND pos0 + {SPAN} > {START} ORDER BY md5(concat(qname, ':', CAST(pos0 AS VARCHAR))), qname, pos0, flag LIMIT 50", m=MD, i=IN))
def w8(s, d):
    return S.sample_reads(_records(s, d), 50).select(*KEY)


@register("j15_fragments", sql("""SELECT qname, r1.contig AS contig, least(r1.pos0, r2.pos0) AS start, greatest(r1.pos0 + CASE WHEN r1.l_linenumber % 4 = 2 THEN r1.mlen + 100 WHEN r1.l_linenumber % 4 = 3 THEN r1.mlen + 3 ELSE r1.mlen END, r2.pos0 + CASE WHEN r2.l_linenumber % 4 = 2 THEN r2.mlen + 100 WHEN r2.l_linenumber % 4 = 3 THEN r2.mlen + 3 ELSE r2.mlen END) AS "end"
 FROM pr WHERE r1.contig = r2.contig AND ((r1.flag & 16) <> 0) <> ((r2.flag & 16) <> 0)""", a=X.ALNC, o=ORD, pr=PAIR))
def j15(s, d):
    return R.fragments(R.mate_pairs(R.passing(alnc(s, d)), KEY)).drop("blocks")


@register("u2_per_sample", sql("SELECT CASE WHEN l_linenumber % 2 = 0 THEN 's0' ELSE 's1' END AS sample, count(*) AS reads, count(*) FILTER (contig = 'chrM') AS mito FROM a WHERE (flag & 2304) = 0 GROUP BY 1", a=X.ALN))
def u2(s, d):
    sample = F.concat(F.lit("s"), (F.col("l_linenumber") % 2).cast("string"))
    return alnc(s, d).filter(~G.flag_is("flag", G.SECONDARY | G.SUPPLEMENTARY)).groupBy(sample.alias("sample")).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("contig") == "chrM").alias("mito"))


@register("u4_distinct_exons", sql('SELECT DISTINCT chrom, e1s AS start, e1e AS "end" FROM t UNION SELECT chrom, e2s, e2e FROM t', t=T))
def u4(s, d):
    return N.exon_rows(transcripts(s, d)).select("chrom", "start", "end").distinct()


@register("t3_sorted_junctions", sql(f'SELECT contig, pos0 + 10 AS start, pos0 + 110 AS "end", count(*) AS reads FROM a WHERE l_linenumber % 4 = 2 AND {PRIMARY} GROUP BY contig, pos0 ORDER BY contig, pos0', a=X.ALNC))
def t3(s, d):
    primary = alnc(s, d).filter(~G.flag_is("flag", 2308)).select("contig", F.explode(G.introns("cigar", "pos0")).alias("j"))
    return primary.groupBy("contig", F.col("j.start").alias("start"), F.col("j.end").alias("end")).agg(F.count(F.lit(1)).alias("reads")).orderBy("contig", "start", "end")


@register("t4_longest_gene", sql("SELECT chrom, gene_id, span FROM (SELECT chrom, gene_id, max(e2e) - min(e1s) AS span FROM e GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY span DESC, CAST(substr(gene_id, 2) AS INT)) = 1", t=T, e=ENDS))
def t4(s, d):
    spans = N.with_ends(transcripts(s, d)).groupBy("chrom", "gene_id").agg((F.max("tx_end") - F.min("tx_start")).alias("span"))
    return spans.groupBy("chrom").agg(F.max_by(F.struct("gene_id", "span"), F.struct("span", -F.substr("gene_id", F.lit(2)).cast("int"))).alias("m")).select("chrom", "m.gene_id", "m.span")
