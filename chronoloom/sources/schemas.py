"""Explicit schemas of the engine's tables. They grow by added fields only."""

from pyspark.sql.types import StructType

_DDL = {
    "samples": "stream_id string, m bigint, x array<float>",
    "frames": "stream_id string, t_ms bigint, h int, w int, px binary",
    "moments": "stream_id string, m bigint, rms double, flux double, centroid double",
    "frame_energies": "stream_id string, t_ms bigint, luminance double, chroma double, transient double",
    "events": "stream_id string, id bigint, ms bigint, strength double",
    "fixations": "stream_id string, t_ms bigint, x double, y double, suppressed boolean",
    "intervals": "stream_id string, event bigint, start bigint, end bigint, peak double",
    "bound_pairs": "stream_id string, left_id bigint, right_id bigint, left_ms bigint, right_ms bigint, dt_ms bigint, left_strength double, right_strength double",
    "segments": "stream_id string, start_ms bigint, end_ms bigint, text string, avg_logprob double, words array<struct<start_ms:bigint,end_ms:bigint,word:string,prob:double>>",
    "sightings": "stream_id string, label string, x double, y double, t_ms bigint, conf double",
    "dialogue": "conv_id bigint, turn bigint, text string, intent string, reply string, region string",
    "manifest": "artifact string, bytes bigint, sha256 string, schema_tag string, generated string, config_hash string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return sorted(_DDL)
