"""Schemas of the records that the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

DETECTION = "struct<label:string,confidence:double,box_xyxy:array<double>,mask_coverage:double,polygon_xy_sample:array<array<double>>>"
DETECTIONS = f"array<{DETECTION}>"
CONTENT_ITEM = "struct<type:string,image:string,text:string>"
MESSAGE = f"struct<role:string,content:array<{CONTENT_ITEM}>>"
MESSAGES = f"array<{MESSAGE}>"
NLI = (
    "struct<premise:string,hypothesis:string,claim_type:string,variables:struct<fault_present:boolean,detection_count:bigint,"
    "max_confidence:double,has_box_overlay:boolean,has_polygon_overlay:boolean>>"
)
VERIFICATION = "struct<label:string,confidence:double,scores:map<string,double>,remove:boolean>"

INSTRUCTION = (
    f"image string, split string, question string, detections {DETECTIONS}, generator_answer_raw string, generator_reasoning array<string>, "
    "generator_answer string, second_answer_raw string, second_reasoning array<string>, second_answer string, merged_answer_raw string, "
    f"merged_reasoning array<string>, merged_answer string, messages_generator {MESSAGES}, messages_second {MESSAGES}, messages_merged {MESSAGES}"
)
SFT = f"image string, question string, answer_source string, detections {DETECTIONS}, reasoning array<string>, answer string, messages {MESSAGES}"
ERROR = "image string, split string, error string"
VERIFIED = f"{INSTRUCTION}, nli {NLI}, verification {VERIFICATION}"
OVERLAY_SFT = f"image string, split string, question string, answer string, fault_label_path string, messages {MESSAGES}"
SPLIT_ROW = "id string, seis string, fault string"
LOG_ITEM = "step bigint, loss double, eval_loss double"
ARCHIVE_CATALOG = "files array<struct<key:string,size:bigint,checksum:string,links:struct<self:string,download:string>>>"
REPOSITORY_CATALOG = (
    "data struct<latestVersion:struct<files:array<struct<label:string,dataFile:struct<id:bigint,filename:string,filesize:bigint>,restricted:boolean>>>>"
)


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
