"""Explicit schemas of the registry tables; stage codes in column names are spelled prelim/decl/award."""

from __future__ import annotations

PROJECT_MANIFEST = (
    "project_id string, project_name string, project_number string, land_required_ha string, "
    "land_available_ha string, land_to_acquire_ha string, land_acquired_ha string"
)
SANCTIONS = "project_id string, sanction_number string, sanction_date string, sanction_amount_rs string"
NOTIFICATIONS = (
    "project_id string, notification_id string, notification_type string, serial_number string, publish_date string, "
    "notification_number string, status string, details_url string, objections_url string"
)
NOTICE_VILLAGES = (
    "project_id string, notification_id string, notification_number string, tentative_publish_date string, "
    "file_number string, cala_name string, village string, action string"
)
SURVEYS = (
    "project_id string, notification_id string, notification_number string, tentative_publish_date string, "
    "serial_number string, district string, sub_district string, village string, survey_number string, "
    "survey_number_raw string, area_hectares string, area_raw string, land_type string, land_nature string, "
    "land_category string, description_raw string, party_count string, owner_count string, "
    "affected_party_count string, total_party_area_hectares string"
)
LAND_PARTIES = (
    "project_id string, notification_id string, notification_number string, survey_serial_number string, "
    "district string, sub_district string, village string, survey_number string, party_sequence string, "
    "party_name string, party_address string, party_type string, party_area_hectares string, party_area_raw string"
)
STAGE_DURATION_POLICY = (
    "stage_transition string, from_stage string, to_stage string, benchmark_type string, benchmark_days int, "
    "source string, confidence string, minimum_observations_required int, current_observations int, "
    "usable_for_ml_label string, notes string"
)
LEGAL_DEADLINES = (
    "rule_id string, process_area string, from_event string, to_event string, deadline_days string, "
    "deadline_type string, source string, source_reference string, confidence string, notes string"
)

# Types that lenient reading casts to; everything else stays text.
TYPED = {
    "project_id": "bigint", "notification_id": "bigint", "serial_number": "int", "survey_serial_number": "int",
    "party_sequence": "int", "party_count": "int", "owner_count": "int", "affected_party_count": "int",
    "land_required_ha": "double", "land_available_ha": "double", "land_to_acquire_ha": "double",
    "land_acquired_ha": "double", "sanction_amount_rs": "double", "area_hectares": "double",
    "party_area_hectares": "double", "total_party_area_hectares": "double",
    "publish_date": "date", "sanction_date": "date",
}
