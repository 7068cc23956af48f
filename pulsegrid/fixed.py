"""Identifiers, names, codes and dates that results depend on.

Everything in this module is a constant of the device family or of the fleet's
maintenance record. Nothing here is computed; operators take these as defaults
and accept other values as parameters.
"""

# --- fixed values: variable taxonomy (id, name, unit, tier, description) -------------------------
VARIABLES = [
    (635, "fio2_measured", "%", 1, "Measured FiO2"),
    (2782, "fio2_setting", "%", 1, "FiO2 setpoint"),
    (2098, "o2_supply_pressure", "kPa", 1, "O2 supply pressure"),
    (2097, "air_supply_pressure", "kPa", 1, "Air supply pressure"),
    (4024, "o2_flow_rate", "L/min", 1, "O2 flow rate"),
    (4113, "air_flow_rate", "L/min", 1, "Air flow rate"),
    (1817, "o2_pressure_alarm", "bool", 1, "O2 pressure alarm active"),
    (2046, "flow_sensor_alarm", "bool", 1, "Flow sensor alarm active"),
    (7629, "o2_sensor_disconnect", "bool", 1, "O2 sensor disconnected"),
    (8024, "circuit_o2", "%", 1, "Circuit O2 concentration"),
    (6501, "o2_replacement", "bool", 1, "O2 sensor replacement needed"),
    (8596, "low_fio2_alarm", "bool", 1, "Low FiO2 alarm"),
    (8597, "high_fio2_alarm", "bool", 1, "High FiO2 alarm"),
    (8625, "high_o2_supply_alarm", "bool", 1, "High O2 supply pressure alarm"),
    (1414, "peak_airway_pressure", "cmH2O", 2, "Peak inspiratory pressure"),
    (1415, "mean_airway_pressure", "cmH2O", 2, "Mean airway pressure"),
    (2324, "insp_tidal_volume", "mL", 2, "Inspiratory tidal volume"),
    (2325, "exp_tidal_volume", "mL", 2, "Expiratory tidal volume"),
    (2326, "exp_minute_volume", "L/min", 2, "Expiratory minute volume"),
    (2092, "insp_minute_volume", "L/min", 2, "Inspiratory minute volume"),
    (1314, "spont_resp_rate", "1/min", 2, "Spontaneous respiratory rate"),
    (5945, "total_resp_rate", "1/min", 2, "Total respiratory rate"),
    (1310, "compliance", "mL/cmH2O", 2, "Lung compliance"),
    (1319, "resistance", "cmH2O/(L/s)", 2, "Airway resistance (R)"),
    (1761, "airway_resistance", "cmH2O/(L/s)", 2, "Airway resistance (Raw)"),
    (2776, "total_peep", "cmH2O", 2, "Total PEEP"),
    (1889, "standby_status", "bool", 3, "Device in standby mode"),
    (584, "vent_mode", "enum", 3, "Ventilation mode"),
    (386, "calibration", "bool", 3, "Calibration in progress"),
]

# --- fixed values: status words, (variable id, bit, name) ----------------------------------------
STATUS_BITS = [
    (801, 1, "Gas Supplies OK"),
    (801, 2, "AC Mains Power OK"),
    (801, 3, "Battery Charge OK"),
    (801, 4, "Manual Circuit Leak OK"),
    (801, 5, "Vent Circuit Leak OK"),
    (801, 6, "Flow Controls OK"),
    (802, 1, "Vent Delivery OK"),
    (802, 4, "Circuit O2 Cell Checked"),
    (803, 0, "Airway Pressure Sensor OK"),
    (803, 1, "Barometric Pressure OK"),
    (803, 2, "Safety Valve OK"),
    (803, 3, "Exhalation Valve OK"),
    (803, 4, "O2 Conc. Sensor OK"),
    (803, 5, "O2 Flow Sensor OK"),
    (803, 6, "Air Flow Sensor OK"),
    (804, 0, "Expiratory Flow Sensor OK"),
    (804, 1, "Inspiratory Flow Sensor OK"),
]

# --- fixed values: model feature order of the status columns -------------------------------------
STATUS_FEATURES = [
    "bitfield_o2_flow_sensor_ok",
    "bitfield_o2_conc_sensor_ok",
    "bitfield_air_flow_sensor_ok",
    "bitfield_inspiratory_flow_sensor_ok",
    "bitfield_expiratory_flow_sensor_ok",
    "bitfield_airway_pressure_sensor_ok",
    "bitfield_barometric_pressure_ok",
    "bitfield_circuit_o2_cell_checked",
    "bitfield_flow_controls_ok",
    "bitfield_gas_supplies_ok",
    "bitfield_ac_mains_power_ok",
    "bitfield_battery_charge_ok",
    "bitfield_safety_valve_ok",
    "bitfield_exhalation_valve_ok",
    "bitfield_vent_circuit_leak_ok",
    "bitfield_manual_circuit_leak_ok",
    "bitfield_vent_delivery_ok",
]

# --- fixed values: engineered features and their display names -----------------------------------
DERIVED_FEATURES = {
    "fio2_deviation": "FiO2 deviation",
    "o2_air_pressure_ratio": "O2/Air pressure ratio",
    "volume_balance": "Volume balance",
}

# --- fixed values: message conventions -----------------------------------------------------------
DEVICE_MARKER = "^Elisa 800"
SERIAL_VARIABLE = "1913"
STANDBY_VARIABLE = 1889
ALARM_WORDS = ["alarm", "failure", "error"]
ON_OFF_TEXT = {"0": "Alarm OFF", "1": "Alarm ON"}
MLLP_START = "\x0b"
MLLP_END = "\x1c\r"
MEASUREMENT_NAME = "pdm_medical_device"

# --- fixed values: labels and units of the variables this library interprets ---------------------
# (id, label, unit). A site's complete label list is passed as the `catalog` parameter instead.
LABELS = [
    ("286", "Generic Alarm 2", "unitless"),
    ("294", "Generic Alarm 10", "unitless"),
    ("295", "Generic Alarm 11", "unitless"),
    ("296", "Generic Alarm 12", "unitless"),
    ("297", "Generic Alarm 13", "unitless"),
    ("298", "Generic Alarm 14", "unitless"),
    ("420", "EtCO2 (CO2)", "%"),
    ("538", "Device Language", "unitless"),
    ("584", "Ventilation Mode", "unitless"),
    ("635", "Inspired O2 (FiO2)", "%"),
    ("757", "Patient Body Weight", "kg"),
    ("801", "Generic Device Status", "unitless"),
    ("802", "Generic Device Status 2", "unitless"),
    ("803", "Generic Device Status 3", "unitless"),
    ("804", "Generic Device Status 4", "unitless"),
    ("808", "Preoxygenation Status", "unitless"),
    ("809", "Postoxygenation Status", "unitless"),
    ("955", "Battery Running Alarm", "unitless"),
    ("1188", "Low Expired Tidal Volume Alarm", "unitless"),
    ("1190", "I:E Ratio", "unitless"),
    ("1310", "Compliance", "mL/cmH2O"),
    ("1314", "Spontaneous Respiration Rate", "1/min"),
    ("1318", "Static Compliance", "mL/cmH2O"),
    ("1319", "Static Resistance", "cmH2O/L/s"),
    ("1320", "Mandatory Respiration Rate Setting", "1/min"),
    ("1321", "Tidal Volume Setting", "mL"),
    ("1347", "Inspiratory Time", "s"),
    ("1348", "Expiratory Time", "s"),
    ("1360", "Nebulizer Activation Status", "unitless"),
    ("1361", "O2 Suction Status", "unitless"),
    ("1370", "Battery Low Alarm", "unitless"),
    ("1381", "Inspiratory Flow Setting", "L/min"),
    ("1383", "Inspiratory Flow Trigger Setting", "L/min"),
    ("1398", "Minute Volume Setting", "mL/kg/min"),
    ("1408", "Inspiratory Rise Time Setting", "s"),
    ("1410", "Patient Category (Ventilator)", "unitless"),
    ("1414", "Peak Airway Pressure", "cmH2O"),
    ("1415", "Mean Airway Pressure", "cmH2O"),
    ("1425", "Delta Esophageal Pressure", "mbar"),
    ("1569", "Minimum Airway Pressure", "cmH2O"),
    ("1657", "Expiratory Trigger Level Setting", "%"),
    ("1761", "Airway Resistance", "cmH2O/L/s"),
    ("1762", "Extrinsic PEEP", "cmH2O"),
    ("1763", "Static Plateau Airway Pressure", "cmH2O"),
    ("1764", "Static Extrinsic PEEP", "cmH2O"),
    ("1816", "Air Pressure Sensor Alarm", "unitless"),
    ("1817", "O2 Pressure Sensor Alarm", "unitless"),
    ("1889", "Device Standby Status", "unitless"),
    ("1913", "Device Serial Number", "unitless"),
    ("1959", "Patient Breathing Status", "unitless"),
    ("2046", "Flow Sensor Alarm", "unitless"),
    ("2092", "Inspired Minute Volume", "L"),
    ("2097", "Air Supply Pressure", "kPa"),
    ("2098", "O2 Supply Pressure", "kPa"),
    ("2102", "Inspiratory Time Setting", "s"),
    ("2104", "Positive End Expiratory Pressure (PEEP) Setting", "cmH2O"),
    ("2117", "High Airway Pressure Alarm", "unitless"),
    ("2119", "Generic Gas Supply Alarm", "unitless"),
    ("2120", "Battery Alarm", "unitless"),
    ("2122", "Device Hardware Error", "unitless"),
    ("2132", "AC Power Supply Failure Alarm", "unitless"),
    ("2255", "Device Date/Time", "unitless"),
    ("2324", "Inspired Tidal Volume", "mL"),
    ("2325", "Expired Tidal Volume", "mL"),
    ("2326", "Expired Minute Volume", "L/min"),
    ("2432", "Expired Spontaneous Tidal Volume", "mL"),
    ("2434", "Spontaneous Expired Minute Volume", "L"),
    ("2446", "Apnea Activation Status", "unitless"),
    ("2546", "Low Expired Minute Volume Alarm", "unitless"),
    ("2583", "I:E Ratio Setting", "unitless"),
    ("2759", "Support Pressure Setting", "cmH2O"),
    ("2776", "Total PEEP", "cmH2O"),
    ("2782", "Inspired O2 (FiO2) Setting", "%"),
    ("2879", "Device Software Revision", "unitless"),
    ("2895", "Device Displayed Unit Code of CO2", "unitless"),
    ("2899", "Flow Sensor Type", "unitless"),
    ("2904", "Inspired CO2 Percentage", "%"),
    ("2968", "Plateau Airway Pressure", "cmH2O"),
    ("2973", "Patient Disconnected Alarm", "unitless"),
    ("2987", "Inspired Pressure Setting", "cmH2O"),
    ("2994", "Device Alarm Audio Volume", "unitless"),
    ("2996", "Drive Gas Type", "unitless"),
    ("31060", "Low Unspecified Respiration Rate Alarm", "unitless"),
    ("32210", "Low Unspecified Tidal Volume Alarm", "unitless"),
    ("32220", "Low Unspecified Minute Volume Alarm", "unitless"),
    ("3258", "Airway Pressure Alarm", "unitless"),
    ("3425", "Ambient Atmospheric Pressure", "mbar"),
    ("3668", "Generic Delta Pressure", "mbar"),
    ("3717", "Generic Pressure Module Error", "unitless"),
    ("386", "Device Calibration Status", "unitless"),
    ("3888", "Sigh Breath Status", "unitless"),
    ("3907", "Control Breath Status", "unitless"),
    ("3981", "Battery Remaining Time", "min"),
    ("4024", "Fresh Gas O2 Flow Rate", "L/min"),
    ("4113", "Fresh Gas Air Flow Rate", "L/min"),
    ("4164", "Minimum Airway Pressure Setting", "mbar"),
    ("4289", "Battery Charge Alarm", "unitless"),
    ("4390", "Device Alarm Silence Status", "unitless"),
    ("4987", "Apnea Ventilation Delay", "s"),
    ("4992", "Maximum Inspired Pressure Setting", "cmH2O"),
    ("5005", "Mechanical Ventilation Activated Status", "unitless"),
    ("50021", "Device Alarm Inactivation State", "unitless"),
    ("50203", "Device Model", "unitless"),
    ("5029", "Pressure Ramp Setting (ASB Ramp)", "s"),
    ("50212", "Device Software Revision", "unitless"),
    ("51052", "SpO2 Pulse Rate", "1/min"),
    ("51107", "SpO2", "%"),
    ("52112", "Mandatory Respiration Rate", "1/min"),
    ("52211", "Expired Tidal Volume", "mL"),
    ("52252", "Airway Dead Space", "mL"),
    ("52253", "Alveolar Tidal Ventilation", "mL"),
    ("52254", "Lung Trapped Volume", "mL"),
    ("52323", "Intrinsic PEEP (PEEPi)", "cmH2O"),
    ("52341", "P0.1 Occlusion Pressure", "cmH2O"),
    ("52515", "End Tidal CO2 Partial Pressure", "mmHg"),
    ("52517", "Inspired CO2 Partial Pressure", "mmHg"),
    ("52865", "CO2 Minute Production", "mL/min"),
    ("5359", "Airway Peak Flow Setting", "L/min"),
    ("5374", "Expiratory Time Constant (RCexp)", "s"),
    ("54013", "Ventilation Mode", "unitless"),
    ("54021", "Ventilation Mode Primary", "unitless"),
    ("54022", "Ventilation Mode Options", "unitless"),
    ("54072", "Ventilator Work of Breathing", "J/L"),
    ("5647", "Ventilation Bias Flow Setting", "L/min"),
    ("5712", "Low EtCO2 Alarm", "unitless"),
    ("5713", "High EtCO2 Alarm", "unitless"),
    ("5945", "Total Respiration Rate", "1/min"),
    ("5972", "Next Ventilation Action Delay Setting", "s"),
    ("7540", "Circuit Leak Rate (Auto Mode)", "mL/min"),
    ("6287", "Patient Circuit Leak Alarm", "unitless"),
    ("6388", "Endotracheal Tube Type", "unitless"),
    ("6389", "Endotracheal Tube Size", "mm"),
    ("6501", "O2 Replacement Alarm", "unitless"),
    ("6507", "Device Display Failure", "unitless"),
    ("6986", "SBT Respiration Rate", "1/min"),
    ("6992", "Volume Limited Alarm", "unitless"),
    ("71063", "High Airway Respiration Rate Alarm", "unitless"),
    ("72111", "High Spontaneous Respiration Rate Alarm", "unitless"),
    ("72210", "High Unspecified Tidal Volume Alarm", "unitless"),
    ("72220", "High Unspecified Minute Volume Alarm", "unitless"),
    ("72312", "High Mean Airway Pressure Alarm", "unitless"),
    ("72313", "High Plateau Airway Pressure Alarm", "unitless"),
    ("7452", "Device Operation Mode", "unitless"),
    ("7629", "O2 Sensor Disconnected Alarm", "unitless"),
    ("7669", "Tidal Volume Indexed By Body Weight Setting", "mL/kg"),
    ("7871", "Truncated Value of Airway Resistance", "cmH2O/L/s"),
    ("7914", "Device Model", "unitless"),
    ("7937", "Cuff Inflation Pressure", "mbar"),
    ("7974", "Low Airway Pressure Alarm", "unitless"),
    ("8023", "Spontaneous Respiration Rate Alarm", "unitless"),
    ("8024", "Circuit O2 Alarm", "unitless"),
    ("810", "Inspiratory Sensor Disconnected Alarm", "unitless"),
    ("811", "Expiratory Sensor Disconnected Alarm", "unitless"),
    ("812", "Fresh Gas Alarm", "unitless"),
    ("822", "Battery Charger Failure", "unitless"),
    ("826", "Device Internal Temperature Alarm", "unitless"),
    ("8301", "Nebulizer Error", "unitless"),
    ("8304", "Front Panel Button Error", "unitless"),
    ("8382", "Peak Inspiratory Pressure Setting", "cmH2O"),
    ("8545", "Device Displayed Unit Code of Pressure", "unitless"),
    ("8546", "Device Displayed Unit Code of Flow", "unitless"),
    ("8556", "Airway Pressure Measurement Source", "unitless"),
    ("8557", "Flow Measurement Source", "unitless"),
    ("8558", "O2 Measurement Source", "unitless"),
    ("8559", "Patient Circuit Leak Alarm Limit", "%"),
    ("8562", "End Flow Setting", "%"),
    ("8577", "Sub-Atmospheric Paw Alarm", "unitless"),
    ("8578", "Pmax Reached Alarm", "unitless"),
    ("8579", "Plimit Reached Alarm", "unitless"),
    ("8580", "PIP Not Achieved Alarm", "unitless"),
    ("8581", "PEEP Not Achieved Alarm", "unitless"),
    ("8582", "Circuit Occlusion Alarm", "unitless"),
    ("8584", "Inspiration Stopped Alarm", "unitless"),
    ("8589", "High Expired Tidal Volume Alarm", "unitless"),
    ("8591", "Volume Apnea Alarm", "unitless"),
    ("8596", "Low FiO2 Alarm", "unitless"),
    ("8597", "High FiO2 Alarm", "unitless"),
    ("8598", "Low Respiration Rate Alarm", "unitless"),
    ("8599", "High Respiration Rate Alarm", "unitless"),
    ("8601", "High FiCO2 Alarm", "unitless"),
    ("8606", "Battery Failure Alarm", "unitless"),
    ("8611", "Fan Failure", "unitless"),
    ("8612", "Heater Failure", "unitless"),
    ("8613", "Breathing System Failure Alarm", "unitless"),
    ("8622", "Primary Audio Failure", "unitless"),
    ("8623", "Backup Audio Failure", "unitless"),
    ("8625", "High O2 Supply Pressure Alarm", "unitless"),
    ("8626", "Air Supply Pressure Alarm", "unitless"),
    ("8627", "Backup Mode Active Status", "unitless"),
    ("8631", "Vent Check Date", "unitless"),
    ("9123", "SBT Duration Setting", "min"),
    ("9145", "RSBI", "unitless"),
    ("9150", "Circuit Compliance Compensation Factor", "%"),
    ("92611", "Air Supply Alarm", "unitless"),
    ("92612", "O2 Supply Alarm", "unitless"),
    ("9277", "Circuit Compliance Level Setting", "mL/cmH2O"),
    ("9285", "Inspiratory Flow Due to Nebulizer", "L/min"),
    ("9288", "Tidal Volume Indexed By Body Weight", "mL/kg"),
    ("9476", "Percent of Leakage", "%"),
    ("9584", "High Expired Minute Volume Alarm", "unitless"),
    ("9891", "Leakage Valve Alarm", "unitless"),
    ("9998", "Watchdog Present", "unitless"),
    ("1131101", "Turbine Filter Replacement Remaining Time", "h"),
    ("1131102", "Extent Compensation Resistance Setting", "%"),
    ("1131103", "Extent Compensation Compliance Setting", "%"),
    ("1131104", "Weaning SAT Performed Time", "unitless"),
    ("1131201", "High Circuit O2 Alarm", "unitless"),
    ("1131202", "PAPS Implausible Alarm", "unitless"),
    ("1131203", "Airway Pressure Negative Alarm", "unitless"),
    ("1131204", "Defective Cuff Alarm", "unitless"),
    ("1131205", "High Cuff Pressure Alarm", "unitless"),
    ("1131206", "Low Resistance Alarm", "unitless"),
    ("1131207", "High Resistance Alarm", "unitless"),
    ("1131208", "Pressure Limitation Alarm", "unitless"),
]

# --- fixed values: coded values, variable id -> {code: text} -------------------------------------
CODED_VALUES = {
    "386": {"0": "Service Calibrations not Due", "1": "Service Calibrations Due"},
    "538": {
        "0": "English", "1": "Spanish", "2": "German", "3": "Kanji", "4": "Dutch",
        "5": "Swedish", "6": "French", "7": "Italian", "8": "Danish", "9": "Polish",
        "A": "Chinese", "B": "Czech", "C": "Hungarian", "D": "Russian", "E": "Portuguese",
        "F": "Other", "G": "Greek", "H": "Finnish", "I": "Turkish", "J": "Norwegian",
        "K": "Serbian", "L": "Slovenian",
    },
    "584": {
        "v": "volume control mode (VCV, CMV)", "p": "pressure control mode (PCV)",
        "s": "SIMV, SIMV-VC", "i": "SIMV-PC", "bb": "BiLevel",
        "gg": "BiLevel-VG / Dyn.BiLevel", "t": "BiLevel-ST", "c": "CPAP, CPAP/PSV",
        "a": "CPAP/Apnea", "n": "CPAP, CPAP/PSV (NIV)", "ii": "SIMV_P (NIV)",
        "nn": "BiLevel (NIV)", "tt": "BiLevel-ST (NIV)",
        "pp": "pressure control mode (PCV) (NIV)", "aa": "CPAP / Apnea (NIV)",
        "hh": "Highflow (NIV)", "mm": "Mandatory BiLevel", "vv": "PC-APRV",
        "dd": "Duales Bilevel", "oo": "Optional BiLevel", "ff": "Flexible BiLevel",
        "cc": "Optional VCV", "ee": "Flexible VCV", "yy": "Dynamic PSV",
        "rr": "Mandatory PSV", "jj": "Post-operative PSV", "kk": "Volume adaptive BiLevel",
        "qq": "Propotional PSV", "uu": "Dyn. BiLevel-ST", "ww": "Dual BiLevel-St",
        "ll": "CPR", "l": "APLV", "xx": "PAPS", "zz": "WOBOV", "d": "NCPAP",
        "e": "nBilevel", "f": "BiLevelNrv",
    },
    "1410": {"a": "adult", "p": "pediatric", "n": "neonate"},
    "1959": {
        "0": "new breath is not triggered",
        "1": "new breath is triggered mandatory",
        "2": "new breath is triggered Spontaneous",
    },
    "2895": {"%": "%", "k": "kPa", "g": "mmHg"},
    "2899": {"i": "Internal (ventilator)"},
    "2996": {"O": "oxygen", "A": "air", "B": "both"},
    "3888": {"0": "Not Mech. Sigh", "1": "Mech. Sigh"},
    "50203": {"E3": "Elisa 300", "E5": "Elisa 500", "E6": "Elisa 600", "E8": "Elisa 800"},
    "6388": {"e": "Endotracheal", "t": "Tracheal", "h": "Helmet", "n": "Nasal", "m": "Mask"},
    "7452": {"i": "Invasive", "n": "Non-invasive"},
    "8545": {"c": "cmH2O", "m": "mbar"},
    "8546": {"m": "L/min"},
    "8556": {"i": "Internal"},
    "8557": {"i": "Internal"},
    "8558": {"i": "Internal"},
    "8627": {"0": "Backup Mode not Active", "1": "Backup Mode Active"},
}

# --- fixed values: unit code -> unit -------------------------------------------------------------
UNIT_CODES = {
    "1": "1/min", "2": "h", "3": "min", "4": "s", "9": "mmHg", "19": "%", "23": "mm",
    "26": "mL", "29": "mL/min", "31": "L", "32": "L/min", "39": "cmH2O", "42": "kPa",
    "44": "mbar", "50": "mL/cmH2O", "51": "cmH2O/L/s", "74": "cm", "76": "kg",
    "106": "mbar/L/s", "139": "unitless", "158": "J/L", "243": "mL/kg",
    "445": "mL/kg/min", "526": "mbar/L",
}

# --- fixed values: fleet registry (maintenance registration number, maintenance serial) ----------
FLEET = [
    (18814, "0408810hul08204503"),
    (18815, "0408810hul08204504"),
    (18816, "0408810hul08204505"),
    (18817, "0408810hul08204506"),
    (18818, "0408810hul08204509"),
    (18819, "0408810hul08204510"),
    (18820, "0408810hul08204511"),
    (18821, "0408810hul08204512"),
    (18822, "0408810hul08204513"),
    (18823, "0408810hul08204514"),
    (18824, "0408810hul08204515"),
    (18825, "0408810hul08204516"),
    (18826, "0408810hul08204517"),
    (18827, "0408810hul08204518"),
    (18828, "0408810hul08204519"),
    (18829, "0408810hul08204520"),
    (18830, "0408810hul08204521"),
    (18831, "0408810hul08204522"),
    (18832, "0408810hul08204523"),
    (18833, "0408810hul08204524"),
    (18834, "0408810hul08204525"),
    (18835, "0408810hul08204526"),
    (18836, "0408810hul08204527"),
    (18837, "0408810hul08204528"),
    (18838, "0408810hul08204529"),
    (18839, "0408810hul08204570"),
    (18840, "0408810hul08204571"),
    (18841, "0408810hul08204572"),
    (18843, "08209508"),
    (18844, "08209509"),
]

# --- fixed values: known failures (registration number, date, description, fault code) -----------
KNOWN_FAILURES = [
    (18823, "2025-12-15", "FiO2 drift: set 0.40, measured 0.36", None),
    (18817, "2025-12-18", "#259 sensor fault during system test", "#259"),
    (18839, "2026-01-09", "#259 O2 flow fault", "#259"),
    (18833, "2026-01-26", "#259 sensor fault", "#259"),
]

# --- fixed values: scheduled services (registration number, date) ---------------------------------
SERVICES = [
    (18815, "2025-12-10"), (18816, "2025-12-09"), (18817, "2025-12-08"), (18818, "2025-12-10"),
    (18819, "2025-12-08"), (18820, "2025-12-10"), (18821, "2025-12-11"), (18823, "2025-12-10"),
    (18824, "2025-12-09"), (18825, "2025-12-08"), (18826, "2025-12-11"), (18827, "2025-12-10"),
    (18828, "2025-12-10"), (18829, "2025-12-10"), (18830, "2025-12-10"), (18831, "2025-12-10"),
    (18832, "2025-12-10"), (18833, "2025-12-09"), (18834, "2025-12-09"), (18835, "2025-12-09"),
    (18836, "2025-12-11"), (18837, "2025-12-11"), (18838, "2025-12-12"), (18839, "2025-12-08"),
    (18840, "2025-12-08"), (18841, "2025-12-09"), (18843, "2025-12-10"), (18844, "2025-12-10"),
]

# --- fixed values: work-order export headers and type words --------------------------------------
WORK_ORDER_HEADERS = {
    "AO-nr.": "work_order_id",
    "AO-type": "work_order_type",
    "Reg. dato": "registered_date",
    "Ferdig": "completed_date",
    "Oppgave/feilbeskrivelse": "fault_description",
    "Teknisk beskrivelse": "technical_description",
    "Reg.nr.": "device_reg",
    "Serienr.": "serial_number",
}
WORK_ORDER_TYPES = {"korrektiv": "corrective", "forebyggende": "preventive"}
EVENT_OF_ORDER_TYPE = {"corrective": "confirmed_fault", "preventive": "scheduled_pv"}

# --- fixed values: alert levels in rising order and their advice ---------------------------------
ALERT_LEVELS = ["normal", "warning", "critical"]
ADVICE = {
    "normal": "No action required",
    "warning": "Schedule inspection at next opportunity — anomalous telemetry pattern detected",
    "critical": "Immediate inspection recommended — possible O2 sensor degradation",
}

# --- fixed values: display name of the derived oxygen feature ------------------------------------
OXYGEN_DEVIATION_NAME = "FiO2 deviation (measured - setting)"

# --- derived lists -------------------------------------------------------------------------------
TIER_IDS = {t: [v[0] for v in VARIABLES if v[3] == t] for t in (1, 2, 3)}
MODEL_IDS = TIER_IDS[1] + TIER_IDS[2]
STATUS_IDS = sorted({b[0] for b in STATUS_BITS})
ALL_IDS = MODEL_IDS + TIER_IDS[3] + STATUS_IDS
MODEL_FEATURES = [f"var_{i}" for i in MODEL_IDS] + STATUS_FEATURES + list(DERIVED_FEATURES)
STATISTICS = ["mean", "std", "min", "max", "delta"]
