"""Input layout: what each source table is called and which columns are read.

Fixed values. Left of the arrow is the name used throughout this package,
right of it the physical name and the type the operators rely on. Lookups that
only decorate a row nobody reads are not part of the layout.
"""

from __future__ import annotations

from typing import NamedTuple


class Source(NamedTuple):
    physical: str
    columns: dict[str, tuple[str, str]]


def _source(physical: str, text: str) -> Source:
    columns = {}
    for line in text.strip().splitlines():
        name, physical_column, data_type = line.split()
        columns[name] = (physical_column, data_type)
    return Source(physical, columns)


SOURCES: dict[str, Source] = {
    # calendar
    "calendar": _source("DIM_DATE_V2", """
        day_date         DAY_DATE              date
        workday          WORKDAY_IND           int
        holiday          HOLIDAY_OBSERVED_IND  int
    """),
    # encounters and organisation
    "encounter": _source("PAT_ENC_HSP", """
        csn              PAT_ENC_CSN_ID        bigint
        pat_id           PAT_ID                string
        admit_ts         HOSP_ADMSN_TIME       timestamp
        disch_ts         HOSP_DISCH_TIME       timestamp
        ed_departure_ts  ED_DEPARTURE_TIME     timestamp
        acuity_c         ACUITY_LEVEL_C        int
        pat_class_c      ADT_PAT_CLASS_C       int
        account_id       HSP_ACCOUNT_ID        bigint
        service_c        HOSP_SERV_C           int
        department_id    DEPARTMENT_ID         bigint
        service_area     ADT_SERV_AREA_ID      int
        admit_conf_c     ADMIT_CONF_STAT_C     int
        patient_stat_c   ADT_PATIENT_STAT_C    int
    """),
    "service_code": _source("ZC_PAT_SERVICE", """
        service_c        HOSP_SERV_C           int
        service_name     NAME                  string
        service_abbr     ABBR                  string
    """),
    "department": _source("CLARITY_DEP", """
        department_id    DEPARTMENT_ID         bigint
        department_name  DEPARTMENT_NAME       string
        unit_group_c     RPT_GRP_FIFTEEN_C     int
        service_area     SERV_AREA_ID          int
    """),
    "unit_group": _source("ZC_DEP_RPT_GRP_15", """
        unit_group_c     RPT_GRP_FIFTEEN_C     int
        unit_group_name  NAME                  string
    """),
    "patient": _source("PATIENT", """
        pat_id           PAT_ID                string
        mother_pat_id    MOTHER_PAT_ID         string
    """),
    "movement": _source("CLARITY_ADT", """
        csn              PAT_ENC_CSN_ID        bigint
        effective_ts     EFFECTIVE_TIME        timestamp
        department_id    DEPARTMENT_ID         bigint
        event_type_c     EVENT_TYPE_C          int
        event_subtype_c  EVENT_SUBTYPE_C       int
    """),
    # pregnancy and delivery
    "contact": _source("PAT_ENC", """
        csn              PAT_ENC_CSN_ID        bigint
        pat_id           PAT_ID                string
        contact_ts       CONTACT_DATE          timestamp
        appt_status_c    APPT_STATUS_C         int
        department_id    EFFECTIVE_DEPT_ID     bigint
        provider_id      VISIT_PROV_ID         string
        entry_ts         ENTRY_TIME            timestamp
    """),
    "appt_status": _source("ZC_APPT_STATUS", """
        appt_status_c    APPT_STATUS_C         int
        appt_status      NAME                  string
    """),
    "provider": _source("CLARITY_SER", """
        provider_id      PROV_ID               string
        provider_name    PROV_NAME             string
    """),
    "episode_link": _source("EPISODE_LINK", """
        csn              PAT_ENC_CSN_ID        bigint
        episode_id       EPISODE_ID            bigint
    """),
    "episode": _source("EPISODE", """
        episode_id       EPISODE_ID            bigint
    """),
    "due_date": _source("OB_HSB_DATING", """
        episode_id       SUMMARY_BLOCK_ID      bigint
        due_user_ts      OB_DT_EDDUSR_DT       timestamp
        due_system_ts    OB_DT_EDDSYS_DT       timestamp
        is_working       OB_DT_WRKEDD_YN       string
    """),
    "delivery": _source("OB_HSB_DELIVERY", """
        csn              DELIVERY_DATE_CSN     bigint
        birth_ts         OB_DEL_BIRTH_DTTM     timestamp
        method_c         OB_DEL_DELIV_METH_C   int
    """),
    "delivery_type": _source("ZC_DELIVERY_TYPE", """
        method_c         DELIVERY_TYPE_C       int
        delivery_type    NAME                  string
    """),
    # surgery
    "surgery_log": _source("OR_LOG", """
        log_id           LOG_ID                string
        status_c         STATUS_C              int
        location_id      LOC_ID                bigint
        surgery_ts       SURGERY_DATE          timestamp
        not_performed_c  PROC_NOT_PERF_C       int
    """),
    "surgery_log_detail": _source("OR_LOG_VIRTUAL", """
        log_id           LOG_ID                string
        procedure_id     PRIMARY_PROC_ID       string
    """),
    "procedure": _source("OR_PROC", """
        procedure_id     OR_PROC_ID            string
        procedure_name   PROC_NAME             string
    """),
    "location": _source("CLARITY_LOC", """
        location_id      LOC_ID                bigint
        location_name    LOC_NAME              string
        service_area     SERV_AREA_ID          int
    """),
    "surgery_status": _source("ZC_OR_STATUS", """
        status_c         STATUS_C              int
        status_name      NAME                  string
    """),
    "admission_link": _source("PAT_OR_ADM_LINK", """
        case_id          OR_CASELOG_ID         string
        admission_csn    OR_LINK_CSN           bigint
        contact_csn      PAT_ENC_CSN_ID        bigint
    """),
    "surgery_case": _source("OR_CASE", """
        case_id          OR_CASE_ID            string
        pat_id           PAT_ID                string
        log_id           LOG_ID                string
        location_id      LOC_ID                bigint
        surgery_ts       SURGERY_DATE          timestamp
        sched_status_c   SCHED_STATUS_C        int
        pat_class_c      PAT_CLASS_C           int
    """),
    "case_procedure": _source("OR_CASE_ALL_PROC", """
        case_id          OR_CASE_ID            string
        line             LINE                  int
        procedure_id     OR_PROC_ID            string
    """),
    # external transfers
    "request": _source("CUST_SERVICE", """
        comm_id          COMM_ID               string
        entry_ts         ENTRY_DATE            timestamp
        topic_c          TOPIC_C               string
        origin_c         REC_COMM_ORIGIN_C     int
    """),
    "request_detail": _source("CUST_SERVICE_TRANSFER", """
        comm_id          COMM_ID               string
        status_c         REQUEST_STATUS_C      int
        transfer_type_c  TRANSFER_TYPE_C       int
        region_id        TRANSFER_REGION_ID    bigint
    """),
    "attachment": _source("CUST_SERV_ATCHMENT", """
        comm_id          COMM_ID               string
        attachment_c     ATCHMENT_TYPE_C       int
        csn              ATCHMENT_PT_CSN_ID    bigint
        target_comm_id   ATCHMENT_NCS_ID       string
        reason_c         ATCHMENT_RSN_C        int
    """),
    "status_history": _source("TC_REQUEST_STATUS_HX", """
        comm_id          COMM_ID                 string
        line             LINE                    int
        status_c         REQUEST_STATUS_C        int
        update_utc_ts    STATUS_UPDATE_UTC_DTTM  timestamp
    """),
    "request_status": _source("ZC_TC_REQUEST_STATUS", """
        status_c         TC_REQUEST_STATUS_C   int
        status_name      NAME                  string
    """),
    "topic": _source("ZC_NCS_TOPIC", """
        topic_c          TOPIC_C               string
        request_type     NAME                  string
    """),
    "transfer_type": _source("ZC_TC_TRANSFER_TYPE", """
        transfer_type_c  TC_TRANSFER_TYPE_C    int
        transfer_type    NAME                  string
    """),
    "conf_status": _source("ZC_CONF_STAT", """
        admit_conf_c     ADMIT_CONF_STAT_C     int
        admit_conf       NAME                  string
    """),
    "patient_status": _source("ZC_PAT_STATUS", """
        patient_stat_c   ADT_PATIENT_STAT_C    int
        patient_stat     NAME                  string
    """),
    # emergency department
    "ed_event_link": _source("ED_IEV_PAT_INFO", """
        event_id         EVENT_ID              bigint
        csn              PAT_ENC_CSN_ID        bigint
    """),
    "ed_event": _source("ED_IEV_EVENT_INFO", """
        event_id         EVENT_ID              bigint
        department_id    EVENT_DEPT_ID         string
        status_c         EVENT_STATUS_C        int
        event_type       EVENT_TYPE            string
    """),
    "acuity": _source("ZC_ACUITY_LEVEL", """
        acuity_c         ACUITY_LEVEL_C        int
        acuity_name      NAME                  string
    """),
}
