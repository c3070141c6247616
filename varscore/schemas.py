"""Explicit schemas of the tables this engine reads. CHROM is always text, POS always long."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields):
    return StructType([StructField(name, kind) for name, kind in fields.items()])


SCORES = _struct(CHROM=StringType(), POS=LongType(), REF=StringType(), ALT=StringType(), score=DoubleType())

GENERATED_SCORES = StructType(
    SCORES.fields
    + _struct(
        TranscriptID=StringType(),
        ProteinID=StringType(),
        ProteinPos=StringType(),
        RefAA=StringType(),
        AltAA=StringType(),
    ).fields
)

SPLIT = _struct(
    CHROM=StringType(), POS=LongType(), REF=StringType(), ALT=StringType(), CLNSIG=StringType(), score=DoubleType()
)

MUTATIONS = _struct(
    transcript_id=StringType(),
    protein_id=StringType(),
    protein_pos=IntegerType(),
    ref_aa=StringType(),
    alt_aa=StringType(),
    score=DoubleType(),
)

GFF = _struct(
    seqid=StringType(),
    source=StringType(),
    type=StringType(),
    start=LongType(),
    end=LongType(),
    gff_score=StringType(),
    strand=StringType(),
    phase=StringType(),
    attributes=StringType(),
)
