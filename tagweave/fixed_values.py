"""Fixed values.

Everything in this module is data that results depend on: parameter bands, built-in
lookup rows, alias words, classification words, document passages, remedy and step
texts, role rights and thresholds. It holds no logic.
"""

# --- Monitored parameters: id, name, short, unit, tag, asset, control, alarm, trip, drivers
PARAMETERS = [
    ("temp", "Reactor Temperature", "Temperature", "°C", "TT-1202B", "BR-12",
     (36.5, 37.5), (36.0, 38.0), (35.5, 38.5),
     ["coolant_flow_rate", "jacket_temperature", "steam_valve_position",
      "heat_exchanger_dp", "agitator_torque"]),
    ("ph", "pH", "pH", "pH", "AT-3401", "BR-12",
     (6.8, 7.2), (6.6, 7.4), (6.4, 7.6),
     ["acid_base_dose_rate", "co2_accumulation", "agitator_speed",
      "probe_drift_mv", "dissolved_oxygen"]),
    ("press", "Differential Pressure", "Pressure", "kPa", "PT-2201", "FIL-07",
     (100.0, 110.0), (96.0, 114.0), (92.0, 118.0),
     ["filter_dp", "gas_exhaust_flow", "pump_speed_hz",
      "valve_position", "seal_integrity_index"]),
    ("cond", "Conductivity (WFI)", "Conductivity", "µS/cm", "CT-5501", "WFI-02",
     (700.0, 900.0), (640.0, 960.0), (600.0, 1000.0),
     ["water_flow_rate", "resin_bed_dp", "regeneration_cycle_count",
      "toc_level", "feed_composition"]),
    ("hum", "Humidity (Cleanroom)", "Humidity", "%", "MT-6601", "CR-A1",
     (40.0, 55.0), (36.0, 59.0), (32.0, 63.0),
     ["hvac_fan_speed", "cooling_coil_temp", "hepa_dp",
      "outdoor_humidity", "door_open_count"]),
]

# --- Extra words that name a parameter (besides its tag, id, short and full name)
PARAMETER_WORDS = {
    "temp": "temp",
    "temperature": "temp",
    "reactortemperature": "temp",
    "ph": "ph",
    "acidity": "ph",
    "press": "press",
    "pressure": "press",
    "differentialpressure": "press",
    "dp": "press",
    "cond": "cond",
    "conductivity": "cond",
    "wfi": "cond",
    "hum": "hum",
    "humidity": "hum",
    "rh": "hum",
    "relativehumidity": "hum",
}

# --- Asset to line: display name, and the segment used in topic paths
ASSET_LINE = {"BR-12": "Line 3", "FIL-07": "Line 3", "WFI-02": "Utility", "CR-A1": "Cleanroom A"}
ASSET_TOPIC_LINE = {"BR-12": "line3", "FIL-07": "line3", "WFI-02": "utility", "CR-A1": "cleanroomA"}
OTHER_LINE, OTHER_TOPIC_LINE = "Line 3", "line3"

# --- Built-in batch table: asset, batch, product, phase, start, end, operator_shift
BATCHES = [
    ("BR-12", "OMZ-114", "Omez", "growth", "2026-08-13T06:00:00", "2026-08-13T18:00:00", "B"),
    ("FIL-07", "NIS-208", "Nise", "filtration", "2026-08-13T05:30:00", "2026-08-13T14:00:00", "B"),
    ("WFI-02", "WFI-DAILY", "WFI", "distribution", "2026-08-13T00:00:00", "2026-08-13T23:59:00", "B"),
    ("CR-A1", "MIN-051", "Mintop", "packaging", "2026-08-13T07:00:00", "2026-08-13T19:00:00", "B"),
]

# --- Built-in material master: product, material_no, family, grade, equipment, spec_source
MATERIALS = [
    ("Omez", "M-0091", "PPI", "USP", "BR-12", "SOP-BSC-001"),
    ("Nise", "M-0142", "NSAID", "USP", "FIL-07", "SOP-BSC-001"),
    ("WFI", "M-0003", "Utility", "USP-WFI", "WFI-02", "SOP-BSC-001"),
    ("Mintop", "M-0210", "Topical", "USP", "CR-A1", "SOP-BSC-001"),
]

# --- Built-in calibration record, the same for every tag but for the lab note number
CALIBRATION_DATE, CALIBRATION_AGE_DAYS = "2026-08-01", 12
CALIBRATION_DRIFT_MV, LAST_MAINTENANCE = 0.1, "2026-07-20"
LAB_NOTE_FORMAT = "LAB-{param}-2026-0{number}"

# --- Ingest constants
TOPIC = "scada.telemetry"
LOG_HEADERS = {"content-type": "application/json", "source": "mqtt-uns", "from_layer": "connectivity"}

# --- Header words of reading files
TAG_HEADERS = ["tag", "parameter", "param"]
VALUE_HEADERS = ["value", "val", "reading"]
TIME_HEADERS = ["timestamp", "ts", "time", "datetime", "date"]
DELIMITERS = [",", ";", "\t", "|"]
READING_FILE_EXTENSIONS = ["xlsx", "xlsm", "xls", "xlsb", "csv", "tsv", "json", "txt"]

# --- Lookup table classification: words in the file name, expected columns
TABLE_NAME_WORDS = {
    "asset": ["asset", "model", "equipment_master", "tag_list"],
    "mes": ["mes", "batch", "work_order", "manufacturing"],
    "sap": ["sap", "material_master", "sku_master"],
    "rdbms": ["rdbms", "lab", "calibrat", "lims", "historian"],
}
TABLE_COLUMNS = {
    "asset": ["tag", "control_lo", "control_hi", "unit", "line", "name"],
    "mes": ["batch", "phase", "operator_shift", "asset", "start", "end"],
    "sap": ["product", "material_no", "family", "grade", "spec_source"],
    "rdbms": ["probe_calibration_date", "calibration_age_days", "last_maintenance",
              "lab_note_ref", "drift_mv"],
}

# --- Column names accepted for each field of an uploaded batch table
BATCH_COLUMN_NAMES = {
    "asset": ["asset", "equipment", "asset_id", "unit"],
    "batch": ["batch", "batch_id", "batch_no", "batch_number", "batchnumber", "work_order",
              "wo", "lot", "lot_no", "lot_id", "order", "order_id"],
    "product": ["product", "product_name", "sku", "material_desc"],
    "phase": ["phase", "operation", "op", "step"],
    "start": ["start", "start_ts", "start_time", "batch_start"],
    "end": ["end", "end_ts", "end_time", "batch_end"],
    "operator_shift": ["operator_shift", "shift", "crew"],
}

# --- Document classification by file name, first rule that matches
DOCUMENT_TYPES = [
    ("CAPA", ["capa"]),
    ("MASTER_INDEX", ["master", "index"]),
    ("REGULATORY", ["regulat", "cfr", "annex", "gxp"]),
    ("OEM", ["oem", "manual"]),
    ("SOP", ["sop"]),
]

# --- File signatures (hex prefix) and content types by extension
FILE_SIGNATURES = [
    ("25504446", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
]
EXTENSION_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "webp": "image/webp", "csv": "text/csv",
    "tsv": "text/tab-separated-values", "txt": "text/plain", "md": "text/markdown",
    "json": "application/json", "html": "text/html", "htm": "text/html",
    "xml": "text/xml", "zip": "application/zip",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}

# --- Retrieval
CHUNK_CHARS = 420
PARAMETER_BOOST = 0.15
CONFIDENT_SCORE = 0.08
CHART_WORDS = ["chart", "distribution", "histogram", "bar graph", "plot",
               "severity", "how many trip", "how many alarm"]
DEFAULT_CITATION = "SOP-BSC-001"

# --- Governed passages: id, type, ref, param, text
PASSAGES = [
    ("SOP-BSC-001-temp", "SOP", "SOP-BSC-001 §5", "temp",
     "Reactor temperature upward excursion: reduce the coolant-loop setpoint in increments of no more than 4 percent; wait one residence time (~90s) between increments and observe the trend. Verify chiller CW-3 discharge is at or below 8C. If heat-exchanger differential pressure exceeds 35 kPa, raise a cleaning work order."),
    ("SOP-BSC-001-ph", "SOP", "SOP-BSC-001 §6", "ph",
     "pH is GxP-critical: all pH setpoint changes require QA electronic signature before execution under 21 CFR Part 11. No autonomous pH adjustment is permitted. Stage base dosing pump P-2 at no more than 3 percent increments; CO2 accumulation is the most frequent driver of downward pH drift."),
    ("SOP-BSC-001-press", "SOP", "SOP-BSC-001 §7", "press",
     "Rising differential pressure on FIL-07 indicates progressive filter blockage. Initiate a filter integrity check; open exhaust vent V-12 in increments up to 10 percent. Compare against the bubble-point recorded at installation; replace filter if it fails bubble point."),
    ("SOP-BSC-001-cond", "SOP", "SOP-BSC-001 §8", "cond",
     "WFI conductivity: cross-check feed composition against the approved recipe. If TOC correlates with the rise, trigger hot-recirculation. Review resin-bed regeneration cycle count; if above 150 the bed is exhausted. Conductivity outside 600-1000 uS/cm renders water non-conforming; isolate the loop."),
    ("SOP-BSC-001-hum", "SOP", "SOP-BSC-001 §9", "hum",
     "Cleanroom humidity: adjust the HVAC fan-speed setpoint in increments up to 6 percent. Inspect cooling-coil temperature; a warm coil cannot dehumidify. Check HEPA differential pressure. Repeated door openings cause transient spikes that are not equipment faults."),
    ("CAPA-2231", "CAPA", "CAPA-2231", "temp",
     "Prior temperature excursion on BR-12 traced to heat-exchanger plate fouling reducing cooling capacity. Corrective action: cleaned the plate pack, reduced coolant setpoint 4 percent during recovery, added a dP trending alarm at 30 kPa. Effective."),
    ("CAPA-1987", "CAPA", "CAPA-1987", "ph",
     "pH drift to 6.55 required a batch hold. Root cause: base dosing pump P-2 actuation lag under rapid CO2 accumulation. Corrective action: replaced actuator, revised SOP to stage dosing at 3 percent increments with QA e-signature."),
    ("CAPA-2104", "CAPA", "CAPA-2104", "press",
     "Differential pressure rose to 116 kPa during filtration; filter had exceeded validated throughput. Corrective action: filter changed, throughput limit added to the batch record as a mandatory check."),
    ("CAPA-2310", "CAPA", "CAPA-2310", "cond",
     "WFI conductivity reached 965 uS/cm due to a feed composition error. Corrective action: recipe verification step added with a second-person check before charging."),
    ("CAPA-2056", "CAPA", "CAPA-2056", "hum",
     "Cleanroom RH fell to 34 percent in winter; cooling coil running warm with low outdoor humidity. Corrective action: HVAC control loop retuned, humidification setpoint seasonally adjusted."),
    ("OEM-CW3-42", "OEM", "OEM-MAN-CW3 §4.2", "temp",
     "Chiller CW-3 reduced cooling capacity: check condenser fouling, refrigerant charge, expansion valve. Maximum permitted coolant setpoint reduction is 5 percent per 90s interval; exceeding it risks thermal shock and voids the exchanger warranty."),
    ("OEM-CW3-51", "OEM", "OEM-MAN-CW3 §5.1", "press",
     "Filter skid FIL-07: rising dP indicates blockage, compare to bubble point. Falling dP may indicate a seal breach or bypass — verify the seal integrity index and escalate immediately as a containment concern."),
    ("OEM-CW3-63", "OEM", "OEM-MAN-CW3 §6.3", "hum",
     "HVAC air handling: the cooling coil is the primary dehumidifier. Coil approach above 3C indicates fouling or low chilled-water flow. HEPA dP above 92 percent of loading restricts airflow and presents as an RH excursion."),
    ("OEM-P2-DOSING", "OEM", "OEM-P2-DOSING", "ph",
     "Base dosing pump P-2: stage stroke at no more than 3 percent per step. Continuous open-loop dosing is not permitted. If the actuator lag exceeds 8 seconds, take the loop to manual and escalate to QA before any further pH change."),
    ("IDX-MASTER-01", "MASTER_INDEX", "RAG_KB_INDEX §1", None,
     "Master Index maps each shop-floor tag to approved knowledge: TT-1202B → SOP-BSC-001 §5 / CAPA-2231 / OEM-MAN-CW3; AT-3401 → SOP-BSC-001 §6 / CAPA-1987 / OEM-P2-DOSING; PT-2201 → SOP-BSC-001 §7 / CAPA-2104; CT-5501 → SOP-BSC-001 §8 / CAPA-2310; MT-6601 → SOP-BSC-001 §9 / CAPA-2056. Regulatory overlay is 21 CFR Part 11 for all GxP tags."),
    ("REG-21CFR11", "REGULATORY", "21 CFR Part 11", None,
     "21 CFR Part 11: electronic records and signatures for GxP actions. pH setpoint changes, trip-zone remedies, and any override of an autonomous agent require a unique QA e-signature, meaning of signature, and a WORM audit trail. Human Escalation owns actions the parameter agent cannot ground with near-perfect RAG confidence."),
    ("REG-SOP-PH-UNDER", "SOP", "SOP-PH-TRIP-UNDER", "ph",
     "pH UNDER trip/alarm: do not raise base flow autonomously. Stage P-2 at <= 3 percent increments, wait for trend confirmation, and obtain QA e-signature before execution. If CO2 accumulation is the driver, hold the batch and escalate."),
    ("REG-SOP-PH-OVER", "SOP", "SOP-PH-TRIP-OVER", "ph",
     "pH OVER trip/alarm: pause acid/base dosing, verify probe calibration age, and do not correct with a single large acid shot. Escalate to Human Escalation if the probe is outside calibration or the batch is in a critical phase."),
]

# --- Remedy summaries by parameter, and the one for a low temperature
REMEDIES = {
    "temp": "Reduce coolant-loop setpoint in increments <= 4%; wait one residence time between steps.",
    "ph": "Stage base dosing at <= 3% increments; QA e-signature required before any pH change.",
    "press": "Initiate filter integrity check; open exhaust vent V-12 in increments <= 10%.",
    "cond": "Cross-check feed composition vs recipe; if TOC-correlated, trigger hot-recirculation.",
    "hum": "Adjust HVAC fan-speed setpoint <= 6%; inspect cooling-coil temperature and HEPA dP.",
}
REMEDY_LOW_TEMP = "Reduce cooling / raise jacket setpoint in increments <= 4%; verify no chiller overshoot."

# --- Four action steps per parameter; {words} are filled from the event and parameter
STEPS = {
    "temp": [
        "Immediately adjust {short} primary control loop setpoint toward the nominal center ({mid} {unit}; band {lo}–{hi}).",
        "Inspect secondary independent variable feedback ({driver}) for thermal or flow restriction.",
        "Verify heat-exchanger differential pressure and valve seating integrity on asset {asset}.",
        "Initiate GxP deviation record under SOP-BSC-001 and alert QA Supervisor for Part 11 e-signature.",
    ],
    "ph": [
        "Hold the batch. Do not change the pH setpoint until QA e-signature is captured (21 CFR Part 11).",
        "Inspect {driver} and base-dosing pump P-2 actuation lag; stage any approved dose at ≤ 3% increments.",
        "Verify probe calibration age and drift on asset {asset} before resuming control.",
        "Open a GxP deviation under SOP-BSC-001 §6 and route to QA for dual review.",
    ],
    "press": [
        "Immediately adjust Differential Pressure primary control loop setpoint to nominal center value ({mid} {unit}).",
        "Inspect secondary independent variable feedback ({driver}) for thermal or pressure restriction.",
        "Verify heat exchanger differential pressure and valve seating integrity on asset {asset}.",
        "Initiate GxP deviation record under SOP-BSC-001 and alert QA Supervisor for Part 11 e-signature.",
    ],
    "cond": [
        "Isolate the WFI loop if conductivity is outside {trip_lo}–{trip_hi} {unit}; otherwise hold charging.",
        "Cross-check feed composition against the approved recipe; if TOC-correlated, trigger hot-recirculation.",
        "Review resin-bed regeneration cycle count and {driver} on asset {asset}.",
        "Raise a CAPA-linked deviation and require second-person verification before the next charge.",
    ],
    "hum": [
        "Adjust HVAC fan-speed setpoint in increments ≤ 6% toward the {lo}–{hi} {unit} band.",
        "Inspect cooling-coil temperature and {driver}; a warm coil cannot dehumidify.",
        "Check HEPA differential pressure on asset {asset}; confirm door-open transients are not the driver.",
        "Log the excursion against SOP-BSC-001 §9; escalate to facilities if coil approach exceeds 3°C.",
    ],
}

# --- Governance outcomes: required, action, approver, control, message
GATE_PH = (True, "ESCALATE", "QA", "21 CFR Part 11 e-signature",
           "pH is GxP-critical -> QA e-signature required (no autonomous action)")
GATE_TRIP = (True, "ESCALATE", "QA + Production", "dual e-signature",
             "trip zone -> human approval required before execution")
GATE_LOW_CONFIDENCE = (True, "ESCALATE", "Shift Lead", "confidence below threshold",
                       "confidence < 0.70 -> route to shift lead")
GATE_AUTONOMOUS = (False, "AUTONOMOUS", None, "policy-permitted, alarm zone",
                   "alarm zone, high confidence -> the agent may act, then log to audit")
CONFIDENCE_THRESHOLD = 0.7

# --- Role rights, breach probability by zone, audit genesis
ROLE_RIGHTS = {
    "operator": ["view", "acknowledge"],
    "shift_lead": ["view", "acknowledge", "approve_low"],
    "qa": ["view", "acknowledge", "approve_low", "esign"],
    "agent": ["view", "act_autonomous"],
}
BREACH_PROBABILITY = {"trip": 0.95, "alarm": 0.90, "control": 0.12}
OTHER_BREACH_PROBABILITY = 0.90
THRESHOLD_RULE = "P(breach) ≥ 0.80"
GENESIS_HASH = "0" * 64
AGENT_ACTOR = "agent"

# --- Co-pilot texts
AGENT_NAMES = {
    "temp": "Temperature Agent", "ph": "pH Agent", "press": "Pressure Agent",
    "cond": "Conductivity Agent", "hum": "Humidity Agent",
    "escalation": "Human Escalation Agent",
}
ESCALATION_NOTE = (
    "Human Escalation owns this when a parameter agent cannot ground a near-perfect remedy. "
    "Require QA e-signature (21 CFR Part 11) and a WORM audit record before execution."
)
NOT_GROUNDED = (
    "{agent_name} could not ground a near-perfect solution in the RAG KB "
    "(CAPA / Master Index / OEM / Regulatory / SOP), and the LLM was unavailable."
)
NOT_GROUNDED_NOTICE = (
    "No confident RAG match. Switch to the Human Escalation Agent for GxP / "
    "Part 11 / cross-parameter guidance."
)
QUESTIONS = {
    ("parameter", "no remedy"): [
        "What did SCADA Intelligence recommend for the latest {name} {zone}?",
        "Which SOP / CAPA / OEM chunks ground the {name} {zone} remedy?",
        "Why is {tag} in {zone} rather than control?",
        "Show a chart of recent {name} trip vs alarm observations",
        "When should Human Escalation override the {name} Agent?",
    ],
    ("parameter", "remedy"): [
        "Explain the SCADA Intel remedy for reading_id {reading_id}",
        "Which RAG sources (CAPA / Master Index / OEM / Regulatory / SOP) support {grounded_on}?",
        "Why was this {name} {zone} not handled autonomously?",
        "Show a chart of recent {name} trip vs alarm observations",
        "When should Human Escalation override the {name} Agent?",
    ],
    ("escalation", "no remedy"): [
        "What are the 21 CFR Part 11 e-signature requirements for GxP breaches?",
        "Show historical CAPA records and root causes across all parameter excursions",
        "When must the Human Escalation Agent override an autonomous parameter agent action?",
        "Generate breach severity distribution chart across all bioprocess parameters",
        "What WORM audit fields are required after a trip-zone remedy is signed?",
    ],
    ("escalation", "remedy"): [
        "Explain the last SCADA Intel remedy for {name} {zone} ({reading_id})",
        "Which RAG sources (CAPA, Master Index, OEM, Regulatory, SOP) ground this override?",
        "When must Human Escalation override the {name} Agent on this {zone}?",
        "Show a chart of trip vs alarm observations across all parameters",
        "What 21 CFR Part 11 e-signature and WORM fields are required before execution?",
    ],
}

# --- Column order of the exported excursion board
EXPORT_COLUMNS = [
    "reading_id", "timestamp", "param", "short", "tag", "value", "unit",
    "status", "zone", "delta", "spec", "asset", "asset_name", "line",
    "batch", "product", "phase", "operator_shift", "mes_window",
    "material_no", "family", "grade", "equipment", "spec_source",
    "calibration_age_days", "probe_calibration_date", "last_maintenance", "lab_note_ref",
]

# --- Search texts of an event, and the lookup SQL shown with them; results depend on the words
EVENT_QUERIES = [
    ("nl", "Diagnosis query", "{short} {status} {zone} excursion on {asset} drivers {drivers} corrective action remedy"),
    ("nl", "SOP retrieve", "SOP excursion response {short} {asset} setpoint control loop"),
    ("nl", "CAPA retrieve", "CAPA historical root cause {asset} {short} {tag}"),
]
DECOMPOSE_TEXT = (
    "SELECT r.reading_id, r.value, a.asset, m.batch, s.material_no\n"
    "FROM readings r\n"
    "JOIN asset_model a ON r.tag = a.tag\n"
    "JOIN mes_batches m ON a.asset = m.asset AND r.ts BETWEEN m.start AND m.end\n"
    "JOIN sap_master s ON m.product = s.product\n"
    "WHERE r.reading_id = '"
)

# --- Sentences of a co-pilot answer, in their order; one is left out when a word of it is missing
ANSWER_PARTS = [
    "Referring to the last SCADA Intelligence {zone} on {reading} ({measured} · {status}).",
    "Automated remedy: {summary}",
    "{passage}",
    "Also see {others}.",
    "{note}",
]
