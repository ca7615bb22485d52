"""Readers of genomic files: FASTQ, BAM, FASTA, GTF, BED, markers and the persisted annotation."""

from helixgrid.sources.annotation import load_annotation, read_bed12, read_gtf
from helixgrid.sources.bam import read_bam
from helixgrid.sources.intervals import read_bed, read_markers, read_targets
from helixgrid.sources.sequences import read_fasta, read_fastq, read_paired_fastq

__all__ = ["load_annotation", "read_bam", "read_bed", "read_bed12", "read_fasta", "read_fastq", "read_gtf", "read_markers", "read_paired_fastq", "read_targets"]
