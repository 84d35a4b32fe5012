"""Prompt templates, task texts and code labels that must equal
the benchmark's wording for prompts to be the same. Kept verbatim, in order."""

# Glasgow coma scale code -> label.
GCS_EYE = {1: "No Response", 2: "To Pain", 3: "To Speech", 4: "Spontaneously"}
GCS_MOTOR = {1: "No Response", 2: "Abnormal Extension", 3: "Abnormal Flexion", 4: "Flex-withdraws",
             5: "Localizes Pain", 6: "Obeys Commands"}
GCS_VERBAL = {1: "No Response", 2: "Incomprehensible sounds", 3: "Inappropriate Words", 4: "Confused",
              5: "Oriented"}

# System prompts per dataset.
SYSTEM_PROMPT = {
    "tjh": "You are an experienced doctor specializing in COVID-19 treatment, skilled in interpreting "
           "longitudinal patient data and predicting clinical outcomes.",
    "mimic-iv": "You are an experienced critical care physician working in an Intensive Care Unit (ICU), "
                "skilled in interpreting complex longitudinal patient data and predicting clinical outcomes.",
}

# Task descriptions.
TASK_DESCRIPTION = {
    "mortality": "Your primary task is to assess the provided medical data and analyze the health records from "
                 "ICU visits to determine the likelihood of the patient not surviving their hospital stay.",
    "los": "Your primary task is to analyze the medical data to predict the length of stay (LOS) in the hospital. "
           "The LOS is defined as the number of days from admission to discharge, including any days spent in "
           "the ICU.",
    "readmission": "Your primary task is to analyze the medical data to predict the probability of readmission "
                   "within 30 days post-discharge. Include cases where a patient passes away within 30 days from "
                   "the discharge date as readmissions.",
}

# Response formats of the structured tasks.
RESPONSE_FORMAT = {
    "mortality": (
        "Please first perform a step-by-step analysis of the patient data, considering trends, abnormal "
        "values relative to reference ranges, and their clinical significance for survival. Then, provide a "
        "final assessment of the likelihood of not surviving the hospital stay.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words).\n"
        "2.  `\"answer\"`: A floating-point number between 0 and 1 representing the predicted probability of "
        "mortality (higher value means higher likelihood of death).\n"
        "\n"
        "Example Format: ```json { \"think\": \"The patient presents with worsening X, stable Y, and improved "
        "Z. Factor A is a major risk indicator... Overall assessment suggests a high risk.\", \"answer\": 0.85 "
        "}```"),
    "los": (
        "Please first perform a step-by-step analysis of the patient data, considering trends, abnormal "
        "values relative to reference ranges, and their clinical significance for length of stay. Then, "
        "provide a final assessment of the predicted length of stay in days.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words).\n"
        "2.  `\"answer\"`: A floating-point number representing the predicted length of stay in days (higher "
        "value means longer stay).\n"
        "\n"
        "Example Format: ```json { \"think\": \"The patient shows stable vitals, but lab results indicate "
        "potential complications. Assuming no major changes, the predicted length of stay is...\", \"answer\": "
        "7 }```"),
    "readmission": (
        "Please first perform a step-by-step analysis of the patient data, considering trends, abnormal "
        "values relative to reference ranges, and their clinical significance for post-discharge stability "
        "and potential complications leading to readmission. Then, provide a final assessment of the "
        "likelihood of readmission within 30 days post-discharge.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words).\n"
        "2.  `\"answer\"`: A floating-point number between 0 and 1 representing the predicted probability of "
        "readmission (higher value means higher likelihood of readmission).\n"
        "\n"
        "Example Format: ```json { \"think\": \"The patient's condition stabilized, but factors X and Y suggest "
        "potential post-discharge issues... Overall assessment indicates a moderate risk of readmission.\", "
        "\"answer\": 0.40 }```"),
}
RESPONSE_FORMAT_MORTALITY = RESPONSE_FORMAT["mortality"]

# The example of a one-shot prompt, by dataset and task.
EXAMPLE = {
    "tjh": {
        "mortality": (
            "Input information of a patient:\n"
            "The patient is a male, aged 52.0 years.\n"
            "The patient had 5 visits that occurred at 2020-02-09, 2020-02-10, 2020-02-13, 2020-02-14, "
            "2020-02-17.\n"
            "Details of the features for each visit are as follows:\n"
            "- Hypersensitive cardiac troponinI (Unit: ng/L. Reference range: less than 14.): [1.9, 1.9, 1.9, "
            "1.9, 1.9]\n"
            "- hemoglobin (Unit: g/L. Reference range: 140 - 180 for men, 120 - 160 for women.): [139.0, 139.0, "
            "142.0, 142.0, 142.0]\n"
            "- Serum chloride (Unit: mmol/L. Reference range: 96 - 106.): [103.7, 103.7, 104.2, 104.2, 104.2]\n"
            "...... (other features omitted for brevity)\n"
            "\n"
            "Response:\n"
            "```json { \"think\": \"The patient is a 52-year-old male. Key labs like Troponin I are consistently "
            "normal and low. Hemoglobin is borderline low for a male but stable. Serum chloride is within normal "
            "limits and stable. Assuming other unlisted vital signs and labs are also stable or within normal "
            "limits, the overall picture suggests a relatively stable condition without indicators of severe "
            "organ damage or rapid decline commonly associated with high mortality risk in this context. The "
            "risk appears low.\", \"answer\": 0.25 } ```\n"),
        "los": (
            "Input information of a patient:\n"
            "The patient is a male, aged 52.0 years.\n"
            "The patient had 5 visits that occurred at 2020-02-09, 2020-02-10, 2020-02-13, 2020-02-14, "
            "2020-02-17.\n"
            "Details of the features for each visit are as follows:\n"
            "- Hypersensitive cardiac troponinI (Unit: ng/L. Reference range: less than 14.): [1.9, 1.9, 1.9, "
            "1.9, 1.9]\n"
            "- hemoglobin (Unit: g/L. Reference range: 140 - 180 for men, 120 - 160 for women.): [139.0, 139.0, "
            "142.0, 142.0, 142.0]\n"
            "- Serum chloride (Unit: mmol/L. Reference range: 96 - 106.): [103.7, 103.7, 104.2, 104.2, 104.2]\n"
            "...... (other features omitted for brevity)\n"
            "\n"
            "Response:\n"
            "```json {\"think\": \"The patient is a 52-year-old male. The provided data spans 5 visits over an "
            "8-day period (Feb 9 to Feb 17), indicating the stay is at least this long. Key available labs show "
            "stability: Hypersensitive cardiac troponin I is consistently low and normal, suggesting no acute "
            "cardiac injury. A prediction around 10-14 days seems reasonable given the stability but also the "
            "duration already observed.\", \"answer\": 12.0 } ```\n"),
    },
    "mimic-iv": {
        "mortality": (
            "Input information of a patient:\n"
            "The patient is a female, aged 52 years.\n"
            "The patient had 4 visits that occurred at 0, 1, 2, 3.\n"
            "Details of the features for each visit are as follows:\n"
            "- Capillary refill rate (Unit: /. Reference range: /.): [\"unknown\", \"unknown\", \"unknown\", "
            "\"unknown\"]\n"
            "- Glascow coma scale eye opening (Unit: /. Reference range: /.): [\"Spontaneously\", \"Spontaneously\", "
            "\"Spontaneously\", \"Spontaneously\"]\n"
            "- Glascow coma scale motor response (Unit: /. Reference range: /.): [\"Obeys Commands\", \"Obeys "
            "Commands\", \"Obeys Commands\", \"Obeys Commands\"]\n"
            "...... (other features omitted for brevity)\n"
            "\n"
            "Response:\n"
            "```json { \"think\": \"Patient is 52 years old. GCS components indicate full alertness and "
            "responsiveness (spontaneous eye opening, obeys commands) consistently across the recorded time "
            "points. While capillary refill is unknown, the neurological status appears stable and good. "
            "Assuming other vital signs and labs (not shown) are not critically deranged, the current data "
            "suggests a lower risk of mortality.\", \"answer\": 0.3 } ```\n"),
        "readmission": (
            "Input information of a patient:\n"
            "The patient is a female, aged 52 years.\n"
            "The patient had 4 visits that occurred at 0, 1, 2, 3.\n"
            "Details of the features for each visit are as follows:\n"
            "- Capillary refill rate (Unit: /. Reference range: /.): [\"unknown\", \"unknown\", \"unknown\", "
            "\"unknown\"]\n"
            "- Glascow coma scale eye opening (Unit: /. Reference range: /.): [\"Spontaneously\", \"Spontaneously\", "
            "\"Spontaneously\", \"Spontaneously\"]\n"
            "- Glascow coma scale motor response (Unit: /. Reference range: /.): [\"Obeys Commands\", \"Obeys "
            "Commands\", \"Obeys Commands\", \"Obeys Commands\"]\n"
            "...... (other features omitted for brevity)\n"
            "\n"
            "Response:\n"
            "```json { \"think\": \"The patient (52F) shows stable and normal neurological status (GCS) throughout "
            "the observed period. Assuming clinical stability in other domains leading to discharge, the risk of "
            "readmission based solely on this neurological data appears relatively low. However, without "
            "information on the primary diagnosis, comorbidities, or discharge status, a definitive low risk "
            "cannot be assumed. Assigning a moderate-low probability.\", \"answer\": 0.3 } ```\n"),
    },
}

# Structured-data user prompt.
USER_PROMPT = (
    "I will provide you with longitudinal medical information for a patient. The data covers {LENGTH} visits "
    "that occurred at {RECORD_TIME_LIST}.\n"
    "Each clinical feature is presented as a list of values, corresponding to these visits. Missing values are "
    "represented as `NaN` for numerical values and \"unknown\" for categorical values. Note that units and "
    "reference ranges are provided alongside relevant features.\n\n"
    "Patient Background:\n- Sex: {SEX}\n- Age: {AGE} years\n\n"
    "Your Task:\n{TASK_DESCRIPTION}\n\n"
    "Instructions & Output Format:\n{RESPONSE_FORMAT}\n\n"
    "Handling Uncertainty:\nIn situations where the provided data is clearly insufficient or too ambiguous to "
    "make a reasonable prediction, respond with the exact phrase: `I do not know`.\n\n"
    "{EXAMPLE}\n\n"
    "Now, please analyze and predict for the following patient:\n\n"
    "Clinical Features Over Time:\n{DETAIL}")

_MM_HEAD = (
    "I will provide you with longitudinal medical information and a clinical note for a patient. The structured "
    "data covers {LENGTH} visits that occurred at {RECORD_TIME_LIST}.\n"
    "Each clinical feature is presented as a list of values, corresponding to these visits. Missing values are "
    "represented as `NaN` for numerical values and \"unknown\" for categorical values. Note that units and "
    "reference ranges are provided alongside relevant features.\n\n"
    "Patient Background:\n- Sex: {SEX}\n- Age: {AGE} years\n\n"
    "Your Task:\n{TASK_DESCRIPTION}\n\n"
    "Instructions & Output Format:\n{RESPONSE_FORMAT}\n\n"
    "Handling Uncertainty:\nIn situations where the provided data is clearly insufficient or too ambiguous to "
    "make a reasonable prediction, respond with the exact phrase: `I do not know`.\n\n"
    "{EXAMPLE}\n\n"
    "Now, please analyze and predict for the following patient:\n")

# Multimodal user prompts (note first / structured data first).
USER_PROMPT_NOTE_FIRST = _MM_HEAD + "Clinical Note:\n{NOTE}\n\nClinical Features Over Time:\n{DETAIL}\n"
USER_PROMPT_EHR_FIRST = _MM_HEAD + "Clinical Features Over Time:\n{DETAIL}\n\nClinical Note:\n{NOTE}\n"

# Multimodal system prompt, task descriptions and response formats.
MM_SYSTEM_PROMPT = {
    "mimic-iv": (
        "You are an experienced critical care physician working in an Intensive Care Unit (ICU), skilled in "
        "interpreting complex longitudinal patient data, including time-series vitals and labs, as well as "
        "unstructured clinical notes to predict clinical outcomes."),
}
MM_TASK_DESCRIPTION = {
    "mortality": (
        "Your primary task is to assess the provided medical data, including both the time-series clinical "
        "features and the unstructured clinical note, to determine the likelihood of the patient not "
        "surviving their hospital stay."),
    "readmission": (
        "Your primary task is to analyze the provided medical data, including both the time-series clinical "
        "features and the unstructured clinical note, to predict the probability of readmission within 30 "
        "days post-discharge. Include cases where a patient passes away within 30 days from the discharge "
        "date as readmissions."),
}
MM_RESPONSE_FORMAT = {
    "mortality": (
        "Please first perform a step-by-step analysis. In your reasoning, you must integrate insights from "
        "both the structured time-series data (considering trends and abnormal values) and the unstructured "
        "clinical note (considering patient history, context, and overall status). Then, provide a final "
        "assessment of the likelihood of not surviving the hospital stay.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words).\n"
        "2.  `\"answer\"`: A floating-point number between 0 and 1 representing the predicted probability of "
        "mortality (higher value means higher likelihood of death).\n"
        "\n"
        "Example Format: ```json { \"think\": \"The patient presents with worsening X, stable Y, and improved "
        "Z, as seen in the time-series data. The clinical note confirms the diagnosis of severe sepsis, "
        "which explains the lab trends. Given the persistent organ dysfunction mentioned in the note and the "
        "unstable vital signs, the overall assessment suggests a high risk.\", \"answer\": 0.85 }```"),
    "readmission": (
        "Please first perform a step-by-step analysis. In your reasoning, you must integrate insights from "
        "both the structured time-series data (considering trends and abnormal values at discharge) and the "
        "unstructured clinical note (considering comorbidities, social situation, and discharge plan). Then, "
        "provide a final assessment of the likelihood of readmission within 30 days post-discharge.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words).\n"
        "2.  `\"answer\"`: A floating-point number between 0 and 1 representing the predicted probability of "
        "readmission (higher value means higher likelihood of readmission).\n"
        "\n"
        "Example Format: ```json { \"think\": \"The patient's vital signs and labs stabilized before discharge. "
        "However, the discharge summary notes a complex medication regimen and limited family support. This "
        "combination of clinical stability but social vulnerability suggests a moderate risk of readmission "
        "due to potential non-adherence or lack of care at home.\", \"answer\": 0.40 }```"),
}

# Note-task system prompt and instructions.
NOTE_SYSTEM_PROMPT = (
    "You are an experienced critical care physician working in an Intensive Care Unit (ICU). You are "
    "skilled in interpreting ICU admission summaries or discharge summaries of patients, and predicting "
    "clinical outcomes based on the patient's status at the time of admission or discharge and their "
    "overall hospital course.")
NOTE_INSTRUCTION = {
    "mortality": (
        "Your primary task is to assess the provided ICU admission summary or discharge summary to determine "
        "the likelihood of the patient not surviving their current hospital stay (in-hospital mortality).\n"
        "\n"
        "Please first perform a step-by-step analysis of the patient data presented in the summary note. "
        "Then, provide a final assessment of the likelihood of in-hospital mortality.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words). "
        "Focus on the factors influencing the mortality risk based on the summary note.\n"
        "2.  `\"answer\"`: A floating-point number between 0.0 and 1.0 representing the predicted probability "
        "of in-hospital mortality (higher value means higher likelihood of death).\n"
        "\n"
        "Example Format: ```json { \"think\": \"The patient was admitted with severe sepsis, required prolonged "
        "ventilation. Although weaned off pressors, renal function remains poor and discharge from ICU is to "
        "the palliative care ward. Key risk factors include persistent organ dysfunction and goals of care "
        "discussion outcomes. Overall assessment suggests a very high risk of not surviving this "
        "hospitalization.\", \"answer\": 0.90 }```"),
    "readmission": (
        "Your primary task is to assess the provided ICU admission summary or discharge summary to predict "
        "the probability of unplanned hospital readmission OR death within 30 days following hospital "
        "discharge.\n"
        "\n"
        "Please first perform a step-by-step analysis of the patient data presented in the summary note. "
        "Then, provide a final assessment of the predicted probability of 30-day readmission or mortality.\n"
        "\n"
        "Your final output must be a JSON object containing two keys:\n"
        "1.  `\"think\"`: A string containing your detailed step-by-step clinical reasoning (under 500 words). "
        "Focus on the factors influencing the 30-day post-discharge risk based on the summary note.\n"
        "2.  `\"answer\"`: A floating-point number between 0.0 and 1.0 representing the predicted probability "
        "of 30-day readmission or death (higher value means higher likelihood of the event).\n"
        "\n"
        "Example Format: ```json { \"think\": \"Patient discharged after prolonged ICU stay for exacerbation of "
        "severe COPD. Discharged on home oxygen and multiple new medications. While stable at discharge, "
        "patient has poor baseline function, multiple comorbidities (CHF, CKD), and a history of frequent "
        "admissions. Limited social support noted. High risk for decompensation or needing further acute "
        "care within 30 days.\", \"answer\": 0.65 }```"),
}
NOTE_INSTRUCTION_MORTALITY = NOTE_INSTRUCTION["mortality"]

# Note headers per dataset and the fine-tuning task prefix.
NOTE_HEADER = {"mimic-iv": "Discharge Summary Note:\n", "mimic-iii": "Admission Summary Note:\n"}
TASK_PREFIX = "Predict patient {TASK} based on the following clinical note: "

# Default prediction for a missing/invalid binary answer.
DEFAULT_BINARY_PRED = 0.501
