"""Column names of the public conjunction-message release and their leakage policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns of a message file, in file order.
CDM_COLUMNS = (
    "event_id", "time_to_tca", "mission_id", "risk", "max_risk_estimate",
    "max_risk_scaling", "miss_distance", "relative_speed",
    "relative_position_r", "relative_position_t", "relative_position_n",
    "relative_velocity_r", "relative_velocity_t", "relative_velocity_n",
    "t_time_lastob_start", "t_time_lastob_end", "t_recommended_od_span",
    "t_actual_od_span", "t_obs_available", "t_obs_used", "t_residuals_accepted",
    "t_weighted_rms", "t_rcs_estimate", "t_cd_area_over_mass",
    "t_cr_area_over_mass", "t_sedr", "t_j2k_sma", "t_j2k_ecc", "t_j2k_inc",
    "t_ct_r", "t_cn_r", "t_cn_t", "t_crdot_r", "t_crdot_t", "t_crdot_n",
    "t_ctdot_r", "t_ctdot_t", "t_ctdot_n", "t_ctdot_rdot", "t_cndot_r",
    "t_cndot_t", "t_cndot_n", "t_cndot_rdot", "t_cndot_tdot", "c_object_type",
    "c_time_lastob_start", "c_time_lastob_end", "c_recommended_od_span",
    "c_actual_od_span", "c_obs_available", "c_obs_used", "c_residuals_accepted",
    "c_weighted_rms", "c_rcs_estimate", "c_cd_area_over_mass",
    "c_cr_area_over_mass", "c_sedr", "c_j2k_sma", "c_j2k_ecc", "c_j2k_inc",
    "c_ct_r", "c_cn_r", "c_cn_t", "c_crdot_r", "c_crdot_t", "c_crdot_n",
    "c_ctdot_r", "c_ctdot_t", "c_ctdot_n", "c_ctdot_rdot", "c_cndot_r",
    "c_cndot_t", "c_cndot_n", "c_cndot_rdot", "c_cndot_tdot", "t_span", "c_span",
    "t_h_apo", "t_h_per", "c_h_apo", "c_h_per", "geocentric_latitude", "azimuth",
    "elevation", "mahalanobis_distance", "t_position_covariance_det",
    "c_position_covariance_det", "t_sigma_r", "c_sigma_r", "t_sigma_t",
    "c_sigma_t", "t_sigma_n", "c_sigma_n", "t_sigma_rdot", "c_sigma_rdot",
    "t_sigma_tdot", "c_sigma_tdot", "t_sigma_ndot", "c_sigma_ndot", "F10", "F3M",
    "SSN", "AP",
)
TEXT_COLUMNS = ("c_object_type",)

# Columns that are not simply safe features.
CDM_LEAKAGE = {
    "event_id": "unsafe",
    "risk": "unsafe",
    "max_risk_estimate": "ambiguous",
    "max_risk_scaling": "ambiguous",
}
CDM_ROLES = {"event_id": "identifier", "mission_id": "group_key", "risk": "target"}
CDM_HARD_EXCLUDED = ("event_id", "risk")


def cdm_policy() -> dict[str, str]:
    """Leakage class of every message column."""
    return {c: CDM_LEAKAGE.get(c, "safe") for c in CDM_COLUMNS}


def policy_table(spark: SparkSession, policy: dict[str, str], roles: dict[str, str] | None = None) -> DataFrame:
    """A policy mapping as a table ``(column, role, leakage_class)``."""
    roles = roles or {}
    rows = [(c, roles.get(c, "feature"), k) for c, k in policy.items()]
    return spark.createDataFrame(rows, "column string, role string, leakage_class string")
