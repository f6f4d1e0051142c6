"""Schemas of the documents that a pipeline leaves on disk."""

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TRANSFORM = _struct(orig_h=_I, orig_w=_I, target_h=_I, target_w=_I, new_h=_I, new_w=_I, offset_x=_I, offset_y=_I, pad_right=_I, pad_bottom=_I, scale=_D, scale_x=_D, scale_y=_D, canvas_origin=_S)
INVERSE = _struct(from_h=_I, from_w=_I, crop_h=_I, crop_w=_I, offset_x=_I, offset_y=_I, to_h=_I, to_w=_I, scale_x=_D, scale_y=_D)
INSTANCE = _struct(
    label_id=_I, component_id=_I, area_native=_I, bbox_native=T.ArrayType(_D), bbox_teacher=T.ArrayType(_D), bbox=T.ArrayType(_D), centroid_native=T.ArrayType(_D), prompt_type=_S,
    point_coords=T.ArrayType(T.ArrayType(_D)), point_labels=T.ArrayType(_I),
)
MANIFEST = _struct(
    dataset_name=_S, fold=_S, split=_S, case_id=_S, patient_id=_S, slice_name=_S, slice_idx=_I, orig_h=_I, orig_w=_I, spacing=T.ArrayType(_D), spacing_xyz=T.ArrayType(_D), spacing_zyx=T.ArrayType(_D),
    geometry_key=_S, native_gt=_S, teacher_img=_S, teacher_gt=_S, student_img=_S, student_gt=_S, student_aux=T.MapType(_S, _S), has_fg=T.BooleanType(),
)
GEOMETRY = _struct(
    case_id=_S, patient_id=_S, slice_idx=_I, native_hw=T.ArrayType(_I), teacher_hw=T.ArrayType(_I), student_hw=T.ArrayType(_I), spacing_xyz=T.ArrayType(_D),
    native_to_teacher=TRANSFORM, native_to_student=TRANSFORM, teacher_to_native=INVERSE, student_to_native=INVERSE,
)
PROMPT = _struct(dataset_name=_S, fold=_S, split=_S, case_id=_S, patient_id=_S, slice_idx=_I, empty_slice=T.BooleanType(), instances=T.ArrayType(INSTANCE), bboxes=T.ArrayType(T.ArrayType(_D)), bbox=T.ArrayType(_D))
SELECTION = _struct(round=_I, selection_type=_S, selected_new_ids=T.ArrayType(_S), cumulative_full_case_ids=T.ArrayType(_S), cumulative_full_slice_names=T.ArrayType(_S), remaining_box_slice_names=T.ArrayType(_S))
PAIR = _struct(pair_id=_S, slice_name=_S, case_id=_S, label_id=_I, component_id=_I, teacher_img=_S, target_mask=_S, bbox_teacher=T.ArrayType(_D), bbox_native=T.ArrayType(_D))
PROGRESS = _struct(
    stage=_S, dataset=_S, fold=_S, split=_S, status=_S, current=T.LongType(), total=T.LongType(), percent=_D, message=_S, started_at=_S, last_update_at=_S, finished_at=_S, elapsed_seconds=_D, stats=T.MapType(_S, _S)
)
