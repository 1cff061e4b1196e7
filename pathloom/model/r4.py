"""The part of FHIR R4 that clinical data uses most, written from the public
specification; types that aren't listed are read by their Spark schema."""

from pathloom.model.provider import Model

R4 = Model(
    "FHIR",
    """
    Element - id:string extension:Extension*
    BackboneElement Element modifierExtension:Extension*
    Resource - id:id meta:Meta implicitRules:uri language:code
    DomainResource Resource text:Narrative contained:Resource* extension:Extension* modifierExtension:Extension*
    Extension Element url:uri value:base64Binary|boolean|canonical|code|date|dateTime|decimal|id|instant|integer|markdown|oid|positiveInt|string|time|unsignedInt|uri|url|uuid|Address|Age|Annotation|Attachment|CodeableConcept|Coding|ContactPoint|Count|Distance|Duration|HumanName|Identifier|Money|Period|Quantity|Range|Ratio|Reference
    Narrative Element status:code div:xhtml
    Meta Element versionId:id lastUpdated:instant source:uri profile:canonical* security:Coding* tag:Coding*
    Coding Element system:uri version:string code:code display:string userSelected:boolean
    CodeableConcept Element coding:Coding* text:string
    Identifier Element use:code type:CodeableConcept system:uri value:string period:Period assigner:Reference<Organization
    Period Element start:dateTime end:dateTime
    Quantity Element value:decimal comparator:code unit:string system:uri code:code
    Age Quantity
    Count Quantity
    Distance Quantity
    Duration Quantity
    SimpleQuantity Quantity
    Money Element value:decimal currency:code
    Range Element low:SimpleQuantity high:SimpleQuantity
    Ratio Element numerator:Quantity denominator:Quantity
    Reference Element reference:string type:uri identifier:Identifier display:string
    HumanName Element use:code text:string family:string given:string* prefix:string* suffix:string* period:Period
    ContactPoint Element system:code value:string use:code rank:positiveInt period:Period
    Address Element use:code type:code text:string line:string* city:string district:string state:string postalCode:string country:string period:Period
    Annotation Element author:Reference|string time:dateTime text:markdown
    Attachment Element contentType:code language:code data:base64Binary url:url size:unsignedInt hash:base64Binary title:string creation:dateTime
    Timing BackboneElement event:dateTime* code:CodeableConcept
    Dosage BackboneElement sequence:integer text:string patientInstruction:string timing:Timing route:CodeableConcept
    Patient DomainResource identifier:Identifier* active:boolean name:HumanName* telecom:ContactPoint* gender:code birthDate:date deceased:boolean|dateTime address:Address* maritalStatus:CodeableConcept multipleBirth:boolean|integer photo:Attachment* contact:Patient.contact* communication:Patient.communication* generalPractitioner:Reference*<Organization,Practitioner managingOrganization:Reference<Organization link:Patient.link*
    Patient.contact BackboneElement relationship:CodeableConcept* name:HumanName telecom:ContactPoint* address:Address gender:code organization:Reference<Organization period:Period
    Patient.communication BackboneElement language:CodeableConcept preferred:boolean
    Patient.link BackboneElement other:Reference<Patient type:code
    Observation DomainResource identifier:Identifier* basedOn:Reference* partOf:Reference* status:code category:CodeableConcept* code:CodeableConcept subject:Reference<Patient focus:Reference* encounter:Reference<Encounter effective:dateTime|Period|Timing|instant issued:instant performer:Reference* value:Quantity|CodeableConcept|string|boolean|integer|Range|Ratio|time|dateTime|Period dataAbsentReason:CodeableConcept interpretation:CodeableConcept* note:Annotation* bodySite:CodeableConcept method:CodeableConcept specimen:Reference device:Reference referenceRange:Observation.referenceRange* hasMember:Reference* derivedFrom:Reference* component:Observation.component*
    Observation.referenceRange BackboneElement low:SimpleQuantity high:SimpleQuantity type:CodeableConcept appliesTo:CodeableConcept* age:Range text:string
    Observation.component BackboneElement code:CodeableConcept value:Quantity|CodeableConcept|string|boolean|integer|Range|Ratio|time|dateTime|Period dataAbsentReason:CodeableConcept interpretation:CodeableConcept* referenceRange:Observation.referenceRange*
    Condition DomainResource identifier:Identifier* clinicalStatus:CodeableConcept verificationStatus:CodeableConcept category:CodeableConcept* severity:CodeableConcept code:CodeableConcept bodySite:CodeableConcept* subject:Reference<Patient encounter:Reference<Encounter onset:dateTime|Age|Period|Range|string abatement:dateTime|Age|Period|Range|string recordedDate:dateTime recorder:Reference asserter:Reference note:Annotation*
    Encounter DomainResource identifier:Identifier* status:code class:Coding type:CodeableConcept* serviceType:CodeableConcept priority:CodeableConcept subject:Reference<Patient period:Period length:Duration reasonCode:CodeableConcept* serviceProvider:Reference<Organization
    Procedure DomainResource identifier:Identifier* status:code category:CodeableConcept code:CodeableConcept subject:Reference<Patient encounter:Reference<Encounter performed:dateTime|Period|string|Age|Range reasonCode:CodeableConcept* bodySite:CodeableConcept* note:Annotation*
    MedicationRequest DomainResource identifier:Identifier* status:code intent:code medication:CodeableConcept|Reference subject:Reference<Patient encounter:Reference<Encounter authoredOn:dateTime requester:Reference reasonCode:CodeableConcept* note:Annotation* dosageInstruction:Dosage*
    DiagnosticReport DomainResource identifier:Identifier* status:code category:CodeableConcept* code:CodeableConcept subject:Reference<Patient encounter:Reference<Encounter effective:dateTime|Period issued:instant performer:Reference* result:Reference*<Observation conclusion:string presentedForm:Attachment*
    Organization DomainResource identifier:Identifier* active:boolean type:CodeableConcept* name:string alias:string* telecom:ContactPoint* address:Address* partOf:Reference<Organization
    Practitioner DomainResource identifier:Identifier* active:boolean name:HumanName* telecom:ContactPoint* address:Address* gender:code birthDate:date
    Questionnaire DomainResource url:uri identifier:Identifier* version:string name:string title:string status:code item:Questionnaire.item*
    Questionnaire.item BackboneElement linkId:string definition:uri code:Coding* prefix:string text:string type:code required:boolean repeats:boolean item:Questionnaire.item*
    QuestionnaireResponse DomainResource identifier:Identifier questionnaire:canonical status:code subject:Reference authored:dateTime item:QuestionnaireResponse.item*
    QuestionnaireResponse.item BackboneElement linkId:string definition:uri text:string answer:QuestionnaireResponse.item.answer* item:QuestionnaireResponse.item*
    QuestionnaireResponse.item.answer BackboneElement value:boolean|decimal|integer|date|dateTime|time|string|uri|Attachment|Coding|Quantity|Reference item:QuestionnaireResponse.item*
    ValueSet DomainResource url:uri identifier:Identifier* version:string name:string title:string status:code expansion:ValueSet.expansion
    ValueSet.expansion BackboneElement identifier:uri timestamp:dateTime total:integer offset:integer parameter:ValueSet.expansion.parameter* contains:ValueSet.expansion.contains*
    ValueSet.expansion.parameter BackboneElement name:string value:string|boolean|integer|decimal|uri|code|dateTime
    ValueSet.expansion.contains BackboneElement system:uri abstract:boolean inactive:boolean version:string code:code display:string contains:ValueSet.expansion.contains*
    CodeSystem DomainResource url:uri identifier:Identifier* version:string name:string title:string status:code content:code count:unsignedInt concept:CodeSystem.concept*
    CodeSystem.concept BackboneElement code:code display:string definition:string concept:CodeSystem.concept*
    Appointment DomainResource identifier:Identifier* status:code description:string start:instant end:instant minutesDuration:positiveInt created:dateTime comment:string participant:Appointment.participant* requestedPeriod:Period*
    Appointment.participant BackboneElement type:CodeableConcept* actor:Reference required:code status:code period:Period
    Parameters Resource parameter:Parameters.parameter*
    Parameters.parameter BackboneElement name:string value:base64Binary|boolean|canonical|code|date|dateTime|decimal|id|instant|integer|markdown|string|time|uri|Coding|CodeableConcept|Quantity|Reference resource:Resource part:Parameters.parameter*
    Bundle Resource identifier:Identifier type:code timestamp:instant total:unsignedInt entry:Bundle.entry*
    Bundle.entry BackboneElement fullUrl:uri resource:Resource
    """,
)
