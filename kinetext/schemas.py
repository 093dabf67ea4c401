"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEYPOINT_KEYS = ("pose_keypoints_2d", "face_keypoints_2d", "hand_left_keypoints_2d", "hand_right_keypoints_2d")
#: Values per array in a stored pose frame, in the order of KEYPOINT_KEYS, and before the upper body is selected.
STORED_SIZES, RAW_SIZES = (39, 210, 63, 63), (75, 210, 63, 63)

PERSON = T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in KEYPOINT_KEYS])
FRAME = T.StructType([T.StructField("people", T.ArrayType(PERSON))])
CAMERA = T.StructType([T.StructField("camera", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("frames", T.MapType(T.StringType(), FRAME))])
BLOCK = T.StructType([T.StructField("entry", T.StringType()), T.StructField("block_idx", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])
POSE_ITEM = T.StructType([T.StructField("gloss", T.StringType()), T.StructField("pose_sequence", T.ArrayType(PERSON))])
POSE_FILE = T.StructType([T.StructField("data", T.ArrayType(POSE_ITEM))])
SENTENCE_POSE_ITEM = T.StructType([T.StructField("full_sentence", T.StringType()), T.StructField("gloss_sequence", T.StringType()), T.StructField("pose_sequence", T.ArrayType(PERSON))])
SENTENCE_POSE_FILE = T.StructType([T.StructField("data", T.ArrayType(SENTENCE_POSE_ITEM))])
PARALLEL = T.StructType([T.StructField("full_sentence", T.StringType()), T.StructField("glosses", T.StringType())])
SENTENCE_VIDEO = T.StructType([T.StructField(c, T.StringType()) for c in ("full_sentence", "gloss_sequence", "video_path", "start_time", "end_time")])
RAW_TIMES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("entry", "block_index", "speaker", "gloss")]
    + [T.StructField(c, T.LongType()) for c in ("gd", "igt", "ogt", "tgt")]
    + [T.StructField(c, T.StringType()) for c in ("igt_index", "ogt_index", "tgt_index")]
    + [T.StructField("lost", T.BooleanType())]
)
GLOSS_TIMES = T.StructType([T.StructField("gloss", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("median_igt", "median_ogt", "median_gd")])
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
EMBEDDING = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("gloss", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
