"""Declared schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    fields = [item.split(":") for item in text.split()]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "programs": _schema(
        "program_id:long program:string faculty:string campus:string department:string level:string "
        "updated_at:timestamp"),
    "courses": _schema(
        "course_id:long course_code:string course_num:string year:long semester:string course_title:string "
        "standard_category_id:long campus:string faculty:string department:string updated_at:timestamp"),
    "course_programs": _schema("course_id:long program_id:long course_required:long map_status:long"),
    "learning_outcomes": _schema(
        "l_outcome_id:long course_id:long l_outcome:string clo_shortphrase:string"),
    "program_learning_outcomes": _schema(
        "pl_outcome_id:long pl_outcome:string plo_shortphrase:string program_id:long plo_category_id:long"),
    "p_l_o_categories": _schema("plo_category_id:long program_id:long plo_category:string"),
    "outcome_maps": _schema("l_outcome_id:long pl_outcome_id:long map_scale_id:long"),
    "outcome_map_ai_suggestions": _schema("l_outcome_id:long pl_outcome_id:long map_scale_id:long"),
    "mapping_scales": _schema(
        "map_scale_id:long title:string abbreviation:string colour:string mapping_scale_categories_id:long"),
    "mapping_scale_programs": _schema("program_id:long map_scale_id:long"),
    "assessment_methods": _schema("a_method_id:long course_id:long a_method:string weight:double"),
    "learning_activities": _schema("l_activity_id:long course_id:long l_activity:string"),
    "outcome_assessments": _schema("l_outcome_id:long a_method_id:long"),
    "outcome_activities": _schema("l_outcome_id:long l_activity_id:long"),
    "standards": _schema(
        "standard_id:long standard_category_id:long s_shortphrase:string s_outcome:string"),
    "standard_scales": _schema(
        "standard_scale_id:long title:string abbreviation:string colour:string scale_category_id:long"),
    "standards_outcome_maps": _schema("standard_id:long course_id:long standard_scale_id:long"),
    "optional_priorities": _schema("op_id:long optional_priority:string subcat_id:long"),
    "optional_priority_subcategories": _schema("subcat_id:long subcat_name:string"),
    "course_optional_priorities": _schema("op_id:long course_id:long"),
    "course_description": _schema("course_id:long description:string"),
    "course_topics": _schema("topic_id:long course_id:long topic:string"),
    "course_materials": _schema("material_id:long course_id:long name:string"),
    "campuses": _schema("campus_id:long campus:string"),
    "faculties": _schema("faculty_id:long faculty:string campus_id:long"),
    "departments": _schema("department_id:long faculty_id:long department:string"),
    "faculty_course_codes": _schema("course_code:string faculty_id:long"),
    "users": _schema("user_id:long name:string"),
    "roles": _schema("role_id:long role:string"),
    "role_user": _schema("user_id:long role_id:long"),
    "department_head": _schema(
        "user_id:long department_id:long has_access_to_all_courses_in_faculty:boolean"),
    "program_directors": _schema(
        "user_id:long program_id:long has_access_to_all_courses_in_faculty:boolean"),
    "course_users": _schema("user_id:long course_id:long permission:long created_at:timestamp"),
    "program_users": _schema("user_id:long program_id:long permission:long"),
    "mapping_requests": _schema(
        "request_id:long course_id:long program_id:long status:string input_path:string "
        "output_path:string created_at:timestamp"),
}
